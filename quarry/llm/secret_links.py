"""Secret scan: strong spans, and weak ones linked by their neighbours.

Column expressions only. Per kind, ``regexp_extract_all`` gives the matches and
``split`` the gaps between them; running lengths of gaps and matches give code
point offsets. Running values are built block by block (``_running``) and texts
are cut in blocks before pieces are taken (``masked``), so no step copies what
is already built: the time grows with the length of a text. Strong kinds
(assign, access, hex) are always reported.

Multipart linking: an access identifier, a secret and an endpoint prove little
alone. Weak candidates of these three parts are intervals inside scopes (the
paragraphs between blank lines). Each candidate joins the intervals of the
other parts in its scope: the join is a merge along the positions of a scope,
which finds the nearest complementary interval on either side and so emits two
rows per candidate at most, never the pairs. The scope alone bounds a link; an optional ``reach`` also bounds the code points between the parts. A weak candidate is reported only when

* an identifier has a secret (weak, or a strong span) linked,
* a secret has an identifier (weak or access) or an endpoint linked,
* an endpoint has a secret linked.

Parts that overlap are no link: a run of characters is one piece of evidence. A
weak secret inside an access span is that span. One inside an endpoint
(identifier) is as likely a path (a long identifier) as a secret, so it links
with parts of the other kinds only, not with further endpoints (identifiers).

Spans are kind:start:end in code points, end exclusive, of whole matches.
Defined cases: a null text counts as empty; repeated rows are scanned each; an
empty table gives an empty result; columns of other names are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import materialise

# Patterns of the base kinds. Runs of one class need no length
# test after the match: a shorter run cannot become longer by a later start.
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_VALUE = 8

# Weak parts: cue, separator, value.
IDENTIFIER = (r"""(?i:client_?id|access_?key(?:_?id)?|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?"""
              r"""([A-Za-z0-9@._-]{4,})""")
SECRET = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9a-z+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{24,}(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"(?:https?|jdbc:[a-z0-9]+|redis|amqps?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?)://[^\x20\x09-\x0D\"'<>]+"

BASE_KINDS = ("assign", "access", "hex")
WEAK_KINDS = ("identifier", "secret", "endpoint")
_BLANK = r"\n[\x20\x09\x0B-\x0D]*\n\s*"

_SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


#: Elements of a block of a running value, code points of a block of text.
BLOCK = 256

# Literals (of the lower-cased text, or of the text itself) without which a pattern cannot match.
_CUES = {"assign": ("password", "passwd", "secret", "token", "api"), "access": ("AKIA",), "endpoint": ("://",),
         "identifier": ("client", "access", "account", "user", "login")}
_LONG_RUN = r"[A-Za-z0-9+/_=-]{24}"


# Expressions are written as SQL text: one call to the JVM each, whatever their size.

def _quoted(literal: str) -> str:
    return "'" + literal.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, use: str) -> str:
    """``use``, where ``name`` stands for ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {use})[0]"


def _running(values: str, combine: str) -> str:
    """For each element of array<bigint> the combination of those before it,
    from 0; ``combine`` joins ``acc.at`` and ``v``. Blocks are combined first, so
    an element is copied a bounded number of times, not once per later element."""
    def scan(items: str, first: str) -> str:
        return (f"aggregate({items}, struct({first} as at, cast(array() as array<bigint>) as out), "
                f"(acc, v) -> struct({combine} as at, concat(acc.out, array(acc.at)) as out), acc -> acc.out)")

    total = f"aggregate(b, 0L, (at, v) -> {combine.replace('acc.at', 'at')})"
    starts = scan(f"transform(bs, b -> {total})", "0L")
    each = f"flatten(zip_with(bs, {starts}, (b, s) -> {scan('b', 's')}))"
    blocks = f"transform(sequence(0, cast((size(vs) - 1) div {BLOCK} as int)), i -> slice(vs, i * {BLOCK} + 1, {BLOCK}))"
    whole = f"if(size(vs) = 0, cast(array() as array<bigint>), {_let('bs', blocks, each)})"
    return _let("vs", values, whole)


def _offsets(text: str, pattern: str, keep: str = "true") -> str:
    """array<struct<start,end>> of the leftmost non-overlapping matches ``m`` that ``keep`` accepts."""
    steps = (f"zip_with(ms, slice(split({text}, {_quoted(pattern)}, -1), 1, size(ms)), (m, gap) -> struct("
             f"cast(length(gap) as bigint) as g, cast(length(m) as bigint) as l, {keep} as ok))")
    before = _running("transform(st, x -> x.g + x.l)", "acc.at + v")
    moved = f"zip_with(st, {before}, (x, at) -> struct(x.ok as ok, at + x.g as start, at + x.g + x.l as end))"
    placed = f"transform(filter({moved}, y -> y.ok), y -> struct(y.start as start, y.end as end))"
    nothing = "cast(array() as array<struct<start:bigint,end:bigint>>)"
    return _let("ms", f"regexp_extract_all({text}, {_quoted(f'({pattern})')}, 1)",
                f"if(size(ms) = 0, {nothing}, {_let('st', steps, placed)})")


def _spans(text: str, kind: str, pattern: str, keep: str = "true") -> str:
    test = f"{text} rlike {_quoted(_LONG_RUN)}" if kind == "secret" else "true"
    if kind in _CUES:
        where = f"lower({text})" if kind in ("assign", "identifier") else text
        test = " or ".join(f"contains({where}, {_quoted(cue)})" for cue in _CUES[kind])
    found = f"transform({_offsets(text, pattern, keep)}, s -> struct({_quoted(kind)} as kind, s.start as start, s.end as end))"
    return f"if({test}, cast({found} as {_SPAN}), cast(array() as {_SPAN}))"


def _base(text: str) -> str:
    value = f"length(regexp_extract(m, {_quoted(ASSIGN)}, 1)) >= {ASSIGN_VALUE}"
    return f"concat({_spans(text, 'assign', ASSIGN, value)}, {_spans(text, 'access', ACCESS)}, {_spans(text, 'hex', HEX)})"


def _weak(text: str) -> str:
    return (f"concat({_spans(text, 'identifier', IDENTIFIER)}, {_spans(text, 'secret', SECRET)}, "
            f"{_spans(text, 'endpoint', ENDPOINT)})")


def scan_text(name: str) -> Column:
    """struct<base,weak,meets,scopes> of the text column ``name`` (null: empty).
    ``base``: strong spans, kind by kind. ``scopes``: starts of the paragraphs
    after the first, only where a weak candidate meets another part."""
    scopes = f"transform({_offsets('t', _BLANK)}, s -> s.end)"
    meets = "size(w) > 0 and size(w) + size(b) > 1"
    both = (f"struct(b as base, w as weak, {meets} as meets, "
            f"if({meets}, {scopes}, cast(array() as array<bigint>)) as scopes)")
    return F.expr(_let("t", f"coalesce(`{name}`, '')", _let("b", _base("t"), _let("w", _weak("t"), both))))


def _scoped(parts: DataFrame) -> DataFrame:
    """rid, scope, kind, start, end from rid, parts, scopes: the number of
    paragraphs begun, by a merge along the positions of a text."""
    entry = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"
    begun = F.transform("scopes", lambda s: F.struct(s, F.lit(0), F.lit(None).cast("string"), s)).cast(entry)
    own = F.transform("parts", lambda p: F.struct(p["start"], F.lit(1), p["kind"], p["end"])).cast(entry)
    along = Window.partitionBy("rid").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = parts.select("rid", F.inline(F.concat(begun, own)))
    return rows.withColumn("scope", F.count_if(F.col("rank") == 0).over(along)).where("rank = 1").select(
        "rid", "scope", "kind", "start", "end")


def link_parts(parts: DataFrame, reach: int | None = None) -> DataFrame:
    """Weak candidates with a complementary part. ``parts``: rid, scope, kind,
    start, end. The merge runs within (rid, scope): one paragraph of one text.
    Each part is met at its start, where the parts that have ended lie on its
    left, and at its end, where the parts that begin later lie on its right."""
    scope = Window.partitionBy("rid", "scope")
    begun = scope.orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def inside(kind: str) -> Column:
        # Spans of one kind do not overlap: the last one begun has the largest end.
        last = F.max(F.when(F.col("kind") == kind, F.col("end"))).over(begun)
        return (F.col("kind") == "secret") & F.coalesce(last >= F.col("end"), F.lit(False))

    p = parts.select("*", inside("identifier").alias("in_i"), inside("endpoint").alias("in_e"),
                     inside("access").alias("in_a")).where(~F.col("in_a"))
    at = p.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("ended")).withColumn(
        "at", F.when(F.col("ended"), F.col("end")).otherwise(F.col("start")))
    before = scope.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = scope.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def near(part: Column) -> Column:
        left = F.max(F.when(part & F.col("ended"), F.col("at"))).over(before)
        right = F.min(F.when(part & ~F.col("ended"), F.col("at"))).over(after)
        gap = F.when(F.col("ended"), right - F.col("at")).otherwise(F.col("at") - left)
        return gap.isNotNull() if reach is None else F.coalesce(gap <= reach, F.lit(False))

    kind = F.col("kind")
    secret = ~kind.isin("identifier", "access", "endpoint")
    n = at.select("*", near(kind == "access").alias("_a"), near(kind == "identifier").alias("_i"),
                  near(kind == "endpoint").alias("_e"), near(secret & ~F.col("in_i")).alias("_si"),
                  near(secret & ~F.col("in_e")).alias("_se"))
    linked = (((kind == "identifier") & F.col("_si")) | ((kind == "endpoint") & F.col("_se"))
              | ((kind == "secret") & (F.col("_a") | (F.col("_i") & ~F.col("in_i")) | (F.col("_e") & ~F.col("in_e")))))
    return n.where(linked).select("rid", "kind", "start", "end")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int | None = None,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: ``id_col``, the ``keep`` columns, ``base`` and ``spans``
    (base and linked weak spans), both array<struct<kind,start,end>>."""
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    names = ["id", *[f"k{i}" for i in range(len(keep))], "base"]
    scanned = materialise(docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("rid"), *kept,
                                      scan_text(text_col).alias("found")).select("rid", *names[:-1], "found.*"))
    # Only rows where a weak candidate meets another part take part in the join.
    meets = F.col("meets")
    parts = _scoped(scanned.where(meets).select("rid", "scopes", F.concat("base", "weak").alias("parts")))
    linked = link_parts(parts, reach).groupBy("rid").agg(
        F.collect_set(F.struct("kind", "start", "end")).alias("linked"))
    extra = F.coalesce(F.col("linked"), F.expr(f"cast(array() as {_SPAN})"))
    alone = scanned.where(~meets).select(*names, F.col("base").alias("spans"))
    joined = scanned.where(meets).join(linked, "rid", "left").select(*names, F.concat("base", extra).alias("spans"))
    return alone.unionByName(joined).toDF(id_col, *keep, "base", "spans")


def masked(text: str, spans: str, mark: str) -> Column:
    """Column ``text`` with each span of column ``spans``, overlapping ones as
    one, replaced by ``mark``. The text is cut into blocks of code points in one
    pass; what lies between two spans is taken from the blocks that hold it."""
    def piece(start: str, end: str) -> str:
        first, last = f"cast({start} div {BLOCK} as int)", f"cast(({end} - 1) div {BLOCK} as int)"
        held = f"array_join(slice(bl, {first} + 1, {last} - {first} + 1), '')"
        return (f"if({end} > {start}, substring({held}, cast({start} - {first} * {BLOCK} + 1 as int), "
                f"cast({end} - {start} as int)), '')")

    in_order = f"array_sort(transform(`{spans}`, s -> struct(s.start as start, s.end as end)))"
    # at: where the spans before have ended
    merged = f"zip_with(o, {_running('transform(o, s -> s.end)', 'greatest(acc.at, v)')}, (s, at) -> struct(s as s, at as at))"
    begun = f"transform(filter(z, q -> q.s.start >= q.at), q -> concat({piece('q.at', 'q.s.start')}, {_quoted(mark)}))"
    rest = _let("e", "array_max(transform(z, q -> q.s.end))", _let("n", f"cast(length(`{text}`) as bigint)", piece("e", "n")))
    blocks = f"regexp_extract_all(`{text}`, '(?s)(.{{1,{BLOCK}}})', 1)"
    whole = _let("bl", blocks, _let("o", in_order, _let("z", merged, f"concat(array_join({begun}, ''), {rest})")))
    return F.expr(f"if(size(`{spans}`) = 0, `{text}`, {whole})")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with reported spans replaced by ``mark``; other texts stay as
    they are, and n_chars follows a changed text where the column exists."""
    names = [f"_q_{i}" for i in range(len(docs.columns))]
    text, key = (names[docs.columns.index(c)] for c in (text_col, id_col))
    own = docs.toDF(*names).withColumn("_q_id", F.col(key))
    found = find_secrets(own, "_q_id", text, reach=None, keep=tuple(names))
    hit = F.size("spans") > 0
    out = found.withColumn("_q_new", masked(text, "spans", mark))

    def column(name: str, inner: str) -> Column:
        if name == text_col:
            return F.col("_q_new").alias(name)
        if name == "n_chars":
            kind = docs.schema[name].dataType
            return F.when(hit, F.length("_q_new").cast(kind)).otherwise(F.col(inner)).alias(name)
        return F.col(inner).alias(name)

    return out.select(*[column(c, n) for c, n in zip(docs.columns, names, strict=True)])


def ordered(spans: Column) -> Column:
    """By start, then kind in the order listed, then end; comma-joined."""
    order = F.create_map(*[x for i, k in enumerate(BASE_KINDS + WEAK_KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("o"),
                                                  s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(id_col, *[number(k) for k in BASE_KINDS], F.sha2(ordered(F.col("base")), 256).alias("base_sha256"),
                        ordered(F.col("spans")).alias("spans"))
