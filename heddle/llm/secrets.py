"""Secret scan with multipart credential linking, in DataFrame functions alone.

Patterns give candidate spans.  Strong kinds are always reported.  Weak ones (an identifier, a
token of mixed characters, an endpoint) are reported only where the complementary parts of a credential
stand within ``SCOPE`` characters and share none with them: an interval join of the candidates of a document, written
as range windows, so pairs are never formed.  An identifier and a secret link each other; an endpoint is linked by both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import free_name

SCOPE = 256


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_LOGIN = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=@-]+)"""
#: kind: (pattern, group whose length counts, least length, part of a credential, strong)
KINDS: dict[str, tuple[str, int, int, str, bool]] = {
    "assign": (f"({_either_case('password|passwd|secret|token|api_?key')}){_VALUE}", 2, 8, "secret", True),
    "access": ("AKIA[A-Z0-9]{12,}", 0, 16, "identifier", True),
    "hex": ("[0-9a-f]{32,}", 0, 32, "secret", True),
    "ident": (f"({_either_case('username|user|login|client_?id|account')}){_LOGIN}", 2, 4, "identifier", False),
    "mixed": ("[A-Za-z0-9+/_-]{20,}", 0, 20, "secret", False),
    "endpoint": ("https?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+", 0, 10, "endpoint", False),
}
ORDER = {kind: i for i, kind in enumerate(KINDS)}


def _candidates(text: Column, kind: str) -> Column:
    """Of one kind: structs of order, the length of the text between, the match's length and whether it counts."""
    pattern, group, least, _, _ = KINDS[kind]
    p = F.lit(pattern)
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, 0).alias("all"), F.regexp_extract_all(text, p, group).alias("value")
    )

    def one(x: Column, i: Column) -> Column:
        good = F.length(x["value"]) >= least
        if kind == "mixed":
            good = good & x["all"].rlike("[0-9]") & x["all"].rlike("[a-z]") & x["all"].rlike("[A-Z]")
        return F.struct(
            F.lit(ORDER[kind]).alias("kind"), i.alias("at"), F.length(x["gap"]).cast("long").alias("gap"), F.length(x["all"]).cast("long").alias("len"), good.alias("good")
        )

    found = F.filter(F.transform(zipped, one), lambda x: x["len"].isNotNull())
    return F.when(text.rlike(pattern), found)


def spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: its id and ``spans``, an array of (start, kind, end, strong, order) by start.

    Positions are code points, ends exclusive.  Null text counts as empty.  Each row of the input gets a
    row, repeated or not; an empty table gives none; a null id stays null; other columns are ignored.
    A very long text is searched whole; its candidates are rows, so they need not fit one value.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    empty = F.array().cast("array<struct<kind:int,at:int,gap:bigint,len:bigint,good:boolean>>")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.select("_row", "_id", F.explode_outer(F.concat(*[F.coalesce(_candidates(text, k), empty) for k in KINDS])).alias("c"))
    by_kind = Window.partitionBy("_row", "kind").orderBy("at")
    end = F.sum(F.col("gap") + F.col("len")).over(by_kind)
    rows = rows.repartition("_row").select("_row", "_id", "c.*").withColumn("end", end).withColumn("start", F.col("end") - F.col("len"))
    part = F.element_at(F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (ORDER[k], v[3])]), F.coalesce(F.col("kind"), F.lit(0)))
    good = F.col("good") & F.col("kind").isNotNull()
    before, after = (Window.partitionBy("_row").orderBy("start").rangeBetween(*x) for x in ((-scope, 0), (0, scope)))

    def near(wanted: Column) -> Column:
        """Whether one of the wanted spans begins within the scope and shares no character with the row's."""
        ends_first = F.min(F.when(wanted, F.col("end"))).over(before) <= F.col("start")
        begins_last = F.max(F.when(wanted, F.col("start"))).over(after) >= F.col("end")
        return F.coalesce(ends_first, F.lit(False)) | F.coalesce(begins_last, F.lit(False))

    partner = F.when(part == "identifier", near(good & (part == "secret"))).when(part == "secret", near(good & (part == "identifier")))
    rows = rows.withColumn("linked", F.coalesce(partner & good, F.lit(False)))
    both = near(F.col("linked") & (part == "identifier")) & near(F.col("linked") & (part == "secret"))
    rows = rows.withColumn("linked", F.col("linked") | ((part == "endpoint") & both))
    strong = F.col("kind").isin(*[ORDER[k] for k, v in KINDS.items() if v[4]])
    names = F.create_map(*[F.lit(x) for k in KINDS for x in (ORDER[k], k)])
    span = F.when(good & (strong | F.col("linked")), F.struct("start", F.col("kind").alias("order"), "end", F.element_at(names, F.coalesce(F.col("kind"), F.lit(0))).alias("kind"), strong.alias("strong")))
    return rows.groupBy("_row").agg(F.first("_id", ignorenulls=True).alias(id_col), F.array_sort(F.collect_list(span)).alias("spans")).drop("_row")


def digest(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Counts, the base spans' hash and all spans as text."""
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["strong"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        id_col,
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", shown), ",").alias("spans"),
    )


def redact(docs: DataFrame, *, mark: str = "[secret]") -> DataFrame:
    """The documents with every reported span replaced by ``mark``; n_chars follows the text.

    Overlapping spans share a mark.  A null text stays null and a text without spans as it is, however long.  Repeated
    rows stay and are treated alike, rows with a null id by their text; an empty table gives an empty one; other
    columns stay as they are, whatever their names.
    """
    key, found_as = free_name(docs.columns, "_key"), free_name(docs.columns, "_found")
    of = F.struct(F.col("doc_id"), F.xxhash64("text"))
    found = spans(docs.select(of.alias(key), "text"), id_col=key).where(F.size("spans") > 0)
    found = found.groupBy(key).agg(F.first("spans").alias(found_as))
    rows = docs.withColumn(key, of)
    rows = rows.join(found, rows[key].eqNullSafe(found[key]), "left").drop(key)
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("to"))

    def put(a: Column, s: Column) -> Column:
        kept = F.substring(F.col("text"), (a["to"] + 1).cast("int"), F.greatest(s["start"] - a["to"], F.lit(0)).cast("int"))
        new = F.when(s["end"] <= a["to"], a["text"]).when(s["start"] < a["to"], a["text"]).otherwise(F.concat(a["text"], kept, F.lit(mark)))
        return F.struct(new.alias("text"), F.greatest(a["to"], s["end"]).alias("to"))

    done = F.aggregate(F.col(found_as), start, put, lambda a: F.concat(a["text"], F.substring(F.col("text"), (a["to"] + 1).cast("int"), F.lit(2**31 - 1))))
    text = F.when(F.col(found_as).isNull(), F.col("text")).otherwise(done)
    out = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        length = F.when(F.col(found_as).isNull(), F.col("n_chars")).otherwise(F.length("text"))
        out = out.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _sql() -> str:
    def one(kind: str) -> str:
        pattern, group, least, _, _ = KINDS[kind]
        p = "'" + pattern.replace("'", "''") + "'"
        mixed = " AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')" if kind == "mixed" else ""
        return f"""SELECT r, {ORDER[kind]} AS o, '{kind}' AS kind, pos, length(g) + length(m) AS step, length(m) AS len, length(v) >= {least}{mixed} AS good
FROM (SELECT r, unnest(regexp_extract_all(t, {p}, 0)) AS m, unnest(regexp_extract_all(t, {p}, {group})) AS v,
  unnest(string_split_regex(t, {p})[1:-2]) AS g, unnest(range(len(regexp_extract_all(t, {p}, 0)))) AS pos FROM d)"""

    part = lambda p, t="s": f"{t}.o IN (" + ", ".join(str(ORDER[k]) for k, v in KINDS.items() if v[3] == p) + ")"
    apart = f'abs(y.start - x.start) <= {SCOPE} AND (y."end" <= x.start OR y.start >= x."end")'
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
c AS ({" UNION ALL ".join(one(k) for k in KINDS)}),
p AS (SELECT *, sum(step) OVER (PARTITION BY r, o ORDER BY pos) AS "end" FROM c),
s AS (SELECT *, "end" - len AS start FROM p WHERE good),
m AS (SELECT *, row_number() OVER () AS i FROM s WHERE {part("identifier")} OR {part("secret")}),
l AS (SELECT DISTINCT x.i FROM m x JOIN m y ON x.r = y.r AND ({part("identifier", "x")}) <> ({part("identifier", "y")}) WHERE {apart}),
t AS (SELECT m.* FROM m JOIN l USING (i)),
u AS (SELECT r, start, "end" FROM s WHERE {part("endpoint")}),
p2 AS (SELECT DISTINCT x.r, x.start FROM u x JOIN t y ON x.r = y.r WHERE {part("identifier", "y")} AND {apart}
  INTERSECT SELECT DISTINCT x.r, x.start FROM u x JOIN t y ON x.r = y.r WHERE {part("secret", "y")} AND {apart}),
w AS (SELECT r, o, start, "end", kind FROM s WHERE o < 3 UNION ALL SELECT r, o, start, "end", kind FROM t WHERE o >= 3
  UNION ALL SELECT s.r, o, s.start, "end", kind FROM s JOIN p2 USING (r, start) WHERE {part("endpoint")}),
k AS (SELECT r, o, start, CAST(start AS BIGINT) || ':' || CAST("end" AS BIGINT) AS x, kind FROM w),
a AS (SELECT r, count(*) FILTER (o = 0) AS n0, count(*) FILTER (o = 1) AS n1, count(*) FILTER (o = 2) AS n2,
  string_agg(kind || ':' || x, ',' ORDER BY start, o) FILTER (o < 3) AS b, string_agg(kind || ':' || x, ',' ORDER BY start, o) AS s FROM k GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans
FROM d LEFT JOIN a USING (r)"""


SQL = _sql()
