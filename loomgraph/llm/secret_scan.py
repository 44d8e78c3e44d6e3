"""Secret scan: patterns for known forms, and character Markov models for the rest.

Patterns find three kinds of base spans. Other long runs of key characters are scored by two Markov models of
characters, one of random strings and one of ordinary identifiers; a run whose log-likelihood ratio reaches ``least`` is a span of the
kind ``markov``, unless it overlaps a base span. Both models learn from labelled samples: (value, is_random) rows; without
other ones these are what the base spans hold, and the words outside base spans of a documented number of documents.

Everything is Spark expressions. Matches are places in the list of what lies between them, so offsets are running sums of lengths; each
match is a row, and a document's rows meet in a window. Offsets are code points, ends exclusive. Null texts are empty and have no
spans; rows are kept one for one, repeated ones and those without an id included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut, table


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The kinds of spans in their order, and the base patterns with the group that must have a number of characters.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = f"({'|'.join(map(either_case, ('password', 'passwd', 'secret', 'token', 'api_?key')))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: Characters of keys, runs of these and of letters, and what a run must be to be scored.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
LEAST_RUN = 20
RUN, KEY, WORD = f"[A-Za-z0-9+/_\\p{{L}}-]{{{LEAST_RUN},}}", "^[A-Za-z0-9+/_-]+$", "[A-Za-z0-9+/_\\p{L}-]{4,}"
#: Documents (expected number) whose words are ordinary samples; pseudo-counts of a transition; share of the uniform distribution in
#: the model of random strings, as what is random need not look like the samples; least log-likelihood ratio of a span.
SAMPLE, PSEUDO, UNIFORM, LEAST = 20_000, 10.0, 0.3, 10.0


def matches(text: Column, kind: int, pattern: str, group: int = 0) -> Column:
    """(kind, nth, gap, hit, value) of every match: gap is what lies before it, in characters, value the pattern's group."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    hits, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    rows = F.transform(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value")), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), x["gap"].alias("gap"), x["hit"].alias("hit"), x["value"].alias("value")))
    return F.when(text.rlike(pattern), rows)


def located(docs: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(row, id) of every document, and (row, kind, start, end, value) of base matches and of runs that may be scored.

    A hexadecimal or access match of too few characters can't hide a longer one, so their length is part of the pattern; an
    assignment that is too short can, so it is dropped afterwards.
    """
    whole = F.coalesce(col(text), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), col(id).alias("id"), whole.alias("text"))
    patterns = ((ASSIGN, 2), (f"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}", 0), (f"[0-9a-f]{{{LEAST_HEX},}}", 0), (RUN, 0))
    rows = cut(rows.select("row", "id", *(matches(F.col("text"), k, p, g).alias(f"m{k}") for k, (p, g) in enumerate(patterns))))
    every = None
    for k in range(len(patterns)):
        own = rows.where(f"m{k} IS NOT NULL").select("row", F.inline(f"m{k}")).where("hit IS NOT NULL")
        every = own if every is None else every.unionByName(own)
    order = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = every.withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(order)).withColumn("start", F.col("end") - F.length("hit"))
    long_enough = (F.col("kind") != 0) | (F.length("value") >= LEAST_ASSIGN)
    return rows.select("row", "id"), placed.where(long_enough & ((F.col("kind") != 3) | F.col("value").rlike(KEY))).select("row", "kind", "start", "end", "value")


def outside(spans: DataFrame) -> DataFrame:
    """Spans without the runs (kind 3) that overlap a base span of their row."""
    w = Window.partitionBy("row").orderBy("start", "kind")
    base = F.col("kind") < 3
    before = F.max(F.when(base, F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(base, F.col("start"))).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    met = spans.withColumn("before", before).withColumn("after", after)
    free = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.col("after").isNull() | (F.col("after") >= F.col("end")))
    return met.where(base | free).drop("before", "after")


def transitions(value: str) -> Column:
    """The pairs of adjacent characters of a column."""
    letters, n = F.split(value, ""), F.greatest(F.length(value) - 1, F.lit(0))
    return F.zip_with(F.slice(letters, F.lit(1), n), F.slice(letters, F.lit(2), n), lambda x, y: F.concat(x, y))


def samples(docs: DataFrame, base: DataFrame, n_docs: int | None, id: str = "doc_id", text: str = "text", most: int = SAMPLE) -> DataFrame:
    """(value, is_random): what base spans hold, and distinct words outside base spans of about ``most`` documents, those with the
    smallest MD5 of their id. Words as long as runs that are scored have no label. n_docs: how many documents there are."""
    share = F.conv(F.substring(F.md5(col(id).cast("string")), 1, 8), 16, 10).cast("bigint")
    bound = (1 << 32) * most // max(1, n_docs)
    rest = col(text)
    for pattern in (ASSIGN, ACCESS, f"[0-9a-f]{{{LEAST_HEX},}}"):
        rest = F.regexp_replace(rest, F.lit(pattern), F.lit(" "))
    words = docs.where(share < bound).select(F.explode(F.regexp_extract_all(rest, F.lit(WORD), F.lit(0))).alias("value")).where(F.length("value") < LEAST_RUN).distinct()
    return base.select("value").distinct().withColumn("is_random", F.lit(True)).unionByName(words.withColumn("is_random", F.lit(False)))


def model(labelled: DataFrame) -> DataFrame:
    """(pair, ratio): for each pair of key characters ln P(second | first, random) - ln P(second | first, ordinary), in millionths.

    A row for each of the alphabet's squared pairs, whatever the samples are. Transitions are smoothed by the frequencies
    of single characters. Without samples of a kind, its model is uniform.
    """
    k = len(ALPHABET)
    counts = labelled.select("is_random", F.explode(transitions("value")).alias("pair")).groupBy("pair").agg(*(F.count(F.when(F.col("is_random") == r, 1)).alias(n) for n, r in (("r", True), ("o", False))))
    one = F.lit(ALPHABET)
    grid = labelled.sparkSession.range(k * k).select(F.substring(one, (F.floor(F.col("id") / k) + 1).cast("int"), F.lit(1)).alias("first"), F.substring(one, (F.col("id") % k + 1).cast("int"), F.lit(1)).alias("second"))
    grid = grid.withColumn("pair", F.concat("first", "second")).join(counts, "pair", "left").fillna(0, ["r", "o"])
    of = {n: {c: F.sum(n).over(Window.partitionBy(c)) for c in ("first", "second")} for n in ("r", "o")}
    grid = cut(grid.select("pair", "r", "o", *(of[n][c].alias(f"{n}_{c}") for n in of for c in of[n])))
    totals = F.broadcast(grid.agg(F.sum("r").alias("r_all"), F.sum("o").alias("o_all")))

    def p(n: str) -> Column:
        single = (F.col(f"{n}_second") + 1) / (F.col(f"{n}_all") + k)
        return (F.col(n) + PSEUDO * single) / (F.col(f"{n}_first") + PSEUDO)

    ratio = F.log((1 - UNIFORM) * p("r") + UNIFORM / k) - F.log(p("o"))
    return grid.crossJoin(totals).select("pair", F.round(ratio * 1_000_000).cast("bigint").alias("ratio"))


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", labelled: DataFrame | None = None, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(row, id) of every document, and (row, kind, start, end, value) of all its spans; kind is a place in ``KINDS``."""
    rows, spans = located(docs, id, text)
    spans = cut(outside(spans))
    if labelled is None:
        labelled = samples(docs, spans.where("kind < 3"), rows.count(), id, text)
    pairs = F.broadcast(model(labelled))  # of fixed size
    scored = spans.where("kind = 3").select("row", "start", F.explode(transitions("value")).alias("pair")).join(pairs, "pair").groupBy("row", "start").agg(F.sum("ratio").alias("ratio"))
    random = scored.where(F.col("ratio") >= int(least * 1_000_000)).select("row", "start")
    return rows, spans.where("kind < 3").unionByName(spans.where("kind = 3").join(random, ["row", "start"], "left_semi").select(*spans.columns))


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256 and spans of every document."""
    rows, spans = scan(docs)
    names = F.array(*map(F.lit, KINDS))
    said = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    sorted_ = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    found = spans.groupBy("row").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{n}") for k, n in enumerate(KINDS)), sorted_.alias("s"))
    found = found.select("row", *(f"n_{n}" for n in KINDS), F.array_join(F.transform(F.filter("s", lambda x: x["kind"] < 3), said), ",").alias("base"), F.array_join(F.transform("s", said), ",").alias("spans"))
    none = F.lit(0).cast("bigint")
    out = rows.join(found, "row", "left").select(F.col("id").alias("doc_id"), *(F.coalesce(f"n_{n}", none).alias(f"n_{n}") for n in KINDS), F.coalesce("base", F.lit("")).alias("base"), F.coalesce("spans", F.lit("")).alias("spans"))
    return out.select("doc_id", *(f"n_{n}" for n in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _found(kind: int, pattern: str, group: int, least: int, more: str = "") -> str:
    """SQL of one kind's matches."""
    p = _quoted(pattern)
    return f"""SELECT n, {kind} AS kind, s + list_sum(gaps[1:i])::BIGINT AS start, s + list_sum(gaps[1:i])::BIGINT + hits[i].length() AS "end", vals[i] AS value
  FROM (SELECT n, list_transform(string_split_regex(text, {p}), lambda x: length(x)) AS gaps, regexp_extract_all(text, {p}) AS hits, regexp_extract_all(text, {p}, {group}) AS vals FROM d WHERE regexp_matches(text, {p})), LATERAL (SELECT i, coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s FROM range(1, len(hits) + 1) r(i))
  WHERE length(vals[i]) >= {least} {more}"""


ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({_found(0, ASSIGN, 2, LEAST_ASSIGN)} UNION ALL {_found(1, ACCESS, 0, LEAST_ACCESS)} UNION ALL {_found(2, HEX, 0, LEAST_HEX)} UNION ALL {_found(3, RUN, 0, LEAST_RUN, f"AND regexp_matches(vals[i], {_quoted(KEY)})")}),
free AS (SELECT * FROM f r WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM f b WHERE b.n = r.n AND b.kind < 3 AND b.start < r."end" AND b."end" > r.start)),
rest AS (SELECT regexp_replace(regexp_replace(regexp_replace(text, {_quoted(ASSIGN)}, ' ', 'g'), {_quoted(ACCESS)}, ' ', 'g'), '[0-9a-f]{{{LEAST_HEX},}}', ' ', 'g') AS text FROM documents WHERE ('0x' || md5(doc_id::VARCHAR)[1:8])::BIGINT < (1::BIGINT << 32) * {SAMPLE} // (SELECT greatest(1, count(*)) FROM documents)),
samples AS (SELECT DISTINCT value, true AS is_random FROM free WHERE kind < 3 UNION ALL SELECT DISTINCT value, false FROM (SELECT unnest(regexp_extract_all(text, {_quoted(WORD)})) AS value FROM rest) WHERE length(value) < {LEAST_RUN}),
pairs AS (SELECT is_random, value[i:i + 1] AS pair FROM samples, LATERAL (SELECT i FROM range(1, length(value)) r(i))),
counts AS (SELECT pair, count(*) FILTER (is_random) AS r, count(*) FILTER (NOT is_random) AS o FROM pairs GROUP BY 1),
alphabet AS (SELECT unnest(string_split('{ALPHABET}', '')) AS c),
grid AS (SELECT a.c || b.c AS pair, a.c AS first, b.c AS second, coalesce(r, 0) AS r, coalesce(o, 0) AS o FROM alphabet a CROSS JOIN alphabet b LEFT JOIN counts ON counts.pair = a.c || b.c WHERE a.c <> '' AND b.c <> ''),
sums AS (SELECT *, sum(r) OVER (PARTITION BY first) AS r1, sum(r) OVER (PARTITION BY second) AS r2, sum(r) OVER () AS ra, sum(o) OVER (PARTITION BY first) AS o1, sum(o) OVER (PARTITION BY second) AS o2, sum(o) OVER () AS oa FROM grid),
model AS (SELECT pair, round(1e6 * (ln({1 - UNIFORM} * (r + {PSEUDO} * (r2 + 1)::DOUBLE / (ra + {len(ALPHABET)})) / (r1 + {PSEUDO}) + {UNIFORM}::DOUBLE / {len(ALPHABET)}) - ln((o + {PSEUDO} * (o2 + 1)::DOUBLE / (oa + {len(ALPHABET)})) / (o1 + {PSEUDO}))))::BIGINT AS ratio FROM sums),
scored AS (SELECT n, start FROM (SELECT n, start, value[i:i + 1] AS pair FROM free, LATERAL (SELECT i FROM range(1, length(value)) r(i)) WHERE kind = 3) JOIN model USING (pair) GROUP BY 1, 2 HAVING sum(ratio) >= {int(LEAST * 1_000_000)}),
spans AS (SELECT * FROM free WHERE kind < 3 UNION ALL SELECT free.* FROM free SEMI JOIN scored ON free.n = scored.n AND free.start = scored.start WHERE kind = 3),
said AS (SELECT n, {', '.join(f"count(*) FILTER (kind = {k}) AS n_{name}" for k, name in enumerate(KINDS))}, string_agg(['assign', 'access', 'hex', 'markov'][kind + 1] || ':' || start || ':' || "end", ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(['assign', 'access', 'hex', 'markov'][kind + 1] || ':' || start || ':' || "end", ',' ORDER BY start, kind) AS spans FROM spans GROUP BY 1)
SELECT doc_id, {', '.join(f'coalesce(n_{name}, 0) AS n_{name}' for name in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN said USING (n)"""


def op12_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))
