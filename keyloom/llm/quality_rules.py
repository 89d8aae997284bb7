"""Quality rules by distribution divergence.

A document's character classes and its language's common words are two histograms.  Each is compared to
the same histogram over all documents of the language by Jensen-Shannon distance (base 2, so 0 to 1).
Short documents, whose histograms say little, are spared by minimum lengths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.shared import keep, spread, table
from keyloom.llm.words import words_array

#: Common words by language.
COMMON = {
    "en": "the of and to in a is that it for was with as on be by are this from at".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au avec".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
#: Unicode classes; the histogram's last bin is all else: letters without case, marks, control characters.
CLASSES = (r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"[\x20\x09-\x0D]", r"[\p{P}\p{S}]")
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.26
MIN_CHARS, MIN_COMMON = 300, 150  # characters, and words, below which a histogram is not judged


def repeated_words(words: Column) -> Column:
    """Number of words inside 3-word windows that occur at least twice."""
    n = F.size(words)
    # equal windows have equal hashes: without an equal pair of hashes there is no repeated window
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))))

    def twice(sorted_windows: Column) -> Column:
        same = F.filter(
            sorted_windows, lambda x, j: (x["w"] == F.get(sorted_windows, j - 1)["w"]) | (x["w"] == F.get(sorted_windows, j + 1)["w"])
        )
        return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    exact = F.get(F.transform(F.array(windows), twice), F.lit(0))
    return F.when(n < 3, 0).when(F.size(F.array_distinct(hashes)) == n - 2, 0).otherwise(exact).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """Base counts and histograms of each document, in one pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.col("lang"), text.alias("text"), words_array(F.col("text")).alias("words"))
    listed = sorted({w for words in COMMON.values() for w in words})
    joined = F.concat(F.lit(" "), F.array_join(F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.isin(listed)), "  "), F.lit(" "))
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))
    # most characters are small letters and spaces: one pass takes them out in long runs, and the short rest is searched for all else
    rest = F.regexp_replace("text", r"[\p{Ll}\x20\x09-\x0D]+", "")
    base = base.withColumns({"joined": joined, "lines": lines, "rest": rest, "n_words": F.size("words").cast("long"), "word_chars": F.length(F.array_join("words", "")).cast("long")})
    marks = reduce(
        lambda found, kv: found.when(F.col("lang") == kv[0], F.array(*[F.lit(f" {w} ") for w in kv[1]])),
        COMMON.items(), F.when(F.lit(False), F.array().cast("array<string>")),
    )
    hits = F.transform(marks, lambda m: ((F.octet_length("joined") - F.octet_length(F.replace(F.col("joined"), m, F.lit("")))) / F.octet_length(m)).cast("long"))
    lower, upper, digits, gaps, marked = CLASSES
    found = {c: F.regexp_count("rest", F.lit(c)).cast("long") for c in (upper, digits, marked)}
    found[gaps] = F.length("text") - F.col("word_chars")
    found[lower] = F.length("text") - F.length("rest") - found[gaps]
    classes = [found[c] for c in CLASSES]
    return base.select(
        "doc_id", "lang", "n_words", "word_chars",
        F.regexp_count("rest", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.length("text").cast("long").alias("n_chars"), F.array(*classes).alias("classes"), hits.alias("common"),
    )


def _shares(counts: Column, total: Column) -> Column:
    """A histogram with what is left of the total as its last bin."""
    n = total.cast("double")
    rest = total - F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.array_append(counts, rest), lambda x: F.when(n > 0, x / n).otherwise(0.0))


def js_distance(p: Column, q: Column) -> Column:
    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, 0.5 * x * F.log2(x / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def judge_quality(docs: DataFrame) -> DataFrame:
    """Base counts, distances to the language's reference, and the verdict for each document.

    Input: ``doc_id``, ``text``, ``lang``; other columns are ignored.  Output: ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``kept``, ``char_distance``, ``word_distance``.  References are the
    summed histograms of all documents of a language that pass the base rules.

    Null text counts as empty and fails the base rules for want of words.  A null language is a language
    of its own.  Languages without a list of common words are judged by character classes alone.
    A distance is 0 where there is nothing to compare with, so such a document is judged by the base rules.
    Repeated rows count as often as they occur; an empty table gives an empty result.
    """
    rows = keep(measure(docs), "quality-measures")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    n_classes, n_common = len(CLASSES), len(next(iter(COMMON.values())))
    sums = {"chars": F.sum("n_chars"), "words": F.sum("n_words")}
    sums |= {f"c{i}": F.sum(F.col("classes")[i]) for i in range(n_classes)} | {f"w{i}": F.sum(F.col("common")[i]) for i in range(n_common)}
    totals = rows.where("not base_failed").groupBy("lang").agg(*[v.alias(k) for k, v in sums.items()])
    reference = keep(
        totals.select(
            "lang",
            _shares(F.array(*[f"c{i}" for i in range(n_classes)]), F.col("chars")).alias("ref_classes"),
            F.when(F.col("w0").isNotNull(), _shares(F.array(*[f"w{i}" for i in range(n_common)]), F.col("words"))).alias("ref_common"),
        ),
        "quality-reference",
    )
    rows = spread(rows, reference, "lang", reference.count(), F.col("doc_id"))
    chars = js_distance(_shares(F.col("classes"), F.col("n_chars")), F.col("ref_classes"))
    words = js_distance(_shares(F.col("common"), F.col("n_words")), F.col("ref_common"))
    rows = rows.withColumns({"char_distance": chars, "word_distance": words})
    odd = ((F.col("n_chars") >= MIN_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE)) | (
        (F.col("n_words") >= MIN_COMMON) & (F.col("word_distance") > MAX_WORD_DISTANCE)
    )
    kept = ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "char_distance", "word_distance"
    )


def op5_quality_rules(spark, sf_dir):
    """The verdicts, with distances to six digits, in which sums of doubles agree whatever their order."""
    judged = judge_quality(table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def _listed(names: list[str]) -> str:
    return "[" + ", ".join(names) + "]"


def _sql() -> str:
    """The same rows in DuckDB's SQL."""
    classes = _listed([f"length(text) - length(regexp_replace(text, '{c}', '', 'g'))" for c in CLASSES])
    marks = " ".join(f"WHEN '{lang}' THEN {_listed([repr(w) for w in words])}" for lang, words in COMMON.items())
    n_classes, n_common = len(CLASSES), len(next(iter(COMMON.values())))
    sums = lambda column, n: _listed([f"CAST(sum({column}[{i + 1}]) AS BIGINT)" for i in range(n)])
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    CASE lang {marks} END AS marks
  FROM documents
), windows AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM d)
), repeats AS (
  SELECT r, count(DISTINCT place) AS n FROM (
    SELECT r, unnest([i, i + 1, i + 2]) AS place FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS times FROM windows) WHERE times > 1
  ) GROUP BY r
), m AS (
  SELECT r, doc_id, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    length(text) AS n_chars, {classes} AS classes,
    list_transform(marks, lambda m: len(list_filter(words, lambda x: lower(x) = m))) AS common
  FROM d
), base AS (
  SELECT m.*, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(n, 0) > 50 * n_words AS base_failed
  FROM m LEFT JOIN repeats USING (r)
), total AS (
  SELECT lang, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(n_words) AS BIGINT) AS words, {sums("classes", n_classes)} AS classes,
    CASE WHEN sum(common[1]) IS NOT NULL THEN {sums("common", n_common)} END AS common
  FROM base WHERE NOT base_failed GROUP BY lang
), shares AS (
  SELECT b.*,
    list_transform(list_append(b.classes, b.n_chars - list_sum(b.classes)), lambda x: CASE WHEN b.n_chars > 0 THEN CAST(x AS DOUBLE) / b.n_chars ELSE 0 END) AS p,
    CASE WHEN t.classes IS NOT NULL THEN list_transform(list_append(t.classes, t.chars - list_sum(t.classes)), lambda x: CASE WHEN t.chars > 0 THEN CAST(x AS DOUBLE) / t.chars ELSE 0 END) END AS q,
    CASE WHEN b.common IS NOT NULL THEN list_transform(list_append(b.common, b.n_words - list_sum(b.common)), lambda x: CASE WHEN b.n_words > 0 THEN CAST(x AS DOUBLE) / b.n_words ELSE 0 END) END AS v,
    CASE WHEN t.common IS NOT NULL THEN list_transform(list_append(t.common, t.words - list_sum(t.common)), lambda x: CASE WHEN t.words > 0 THEN CAST(x AS DOUBLE) / t.words ELSE 0 END) END AS w
  FROM base b LEFT JOIN total t ON b.lang IS NOT DISTINCT FROM t.lang
), far AS (
  SELECT *, {_js_sql("p", "q")} AS char_distance, {_js_sql("v", "w")} AS word_distance FROM shares
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(n_chars >= {MIN_CHARS} AND char_distance > {MAX_CHAR_DISTANCE}, false) AND NOT coalesce(n_words >= {MIN_COMMON} AND word_distance > {MAX_WORD_DISTANCE}, false) AS kept,
  round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance
FROM far
"""


def _js_sql(p: str, q: str) -> str:
    part = lambda x: f"CASE WHEN {x}[i] > 0 THEN 0.5 * {x}[i] * log2({x}[i] / (({p}[i] + {q}[i]) / 2)) ELSE 0 END"
    return f"CASE WHEN {p} IS NOT NULL AND {q} IS NOT NULL THEN sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: {part(p)} + {part(q)})), 0)) ELSE 0 END"


OP5_SQL = _sql()
