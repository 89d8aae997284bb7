"""Secret scan: candidate strings, and a random forest that removes false positives.

Candidates are long runs of key-like characters, whatever is assigned to a credential's name, and passwords in URLs.
Values of a form that only secrets have are secret; the forest decides about the others.  It sees the candidate's length and character
transitions, how much of it dictionary words cover, whether it stands in a path, and the words beside it.  It learns from
labelled findings; then its trees are one SQL expression, so that scanning and redacting are plain projections of
the documents, without a join.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.shared import keep, table
from keyloom.llm.words import words_array

#: What may stand between a credential's name and its value; Java wants it bounded to look back over it.
ASSIGNMENT = r"(?i:token(?!i[sz])|secret|passw|passphrase|pwd|api.?key|access.?key|credential|private|auth(?!ors?\b))[\w.-]{0,20}[\"'`]?\s{0,2}[:=][=>]?\s{0,2}[\"'`]?(?:(?i:bearer|basic|token)\s{1,2})?"
BEARER = r"(?i:\bbearer)\s{1,2}"
URL_USER = r"://[^\s/@:]{0,32}:"
#: Assigned values (quoted ones whole), passwords of URLs, and runs, which end at '=' and ':' but for padding.  The short looks back come first as
#: nearly all places fail them.
CANDIDATE = (
    rf"(?<=[\s:=>\"'`])(?<=[:=>]\s{{0,2}}[\"'`]?|(?i:bearer|basic|token)\s{{1,2}})(?<={ASSIGNMENT}|{BEARER})"
    r"(?:(?<=[\"'`])[^\"'`\n]{4,}+(?=[\"'`])|[^\s\"'`,;<>]{4,}+)"
    rf"|(?<=:)(?<={URL_USER})[^\s/@]{{3,}}+(?=@)"
    r"|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_\"'-]))?"
)
SHORTEST = 4  # characters of a candidate and what parts it from the next, less one
CONTEXT = 40  # characters looked at on each side
TRAIN_FINDINGS = 20_000  # about so many labelled findings train the forest
TREES, DEPTH = 12, 5
DICTIONARY_WORDS = 400  # most frequent words of the corpus whose letters count as covered, besides
#: words of addresses and placeholders, which prose does not show.
WEB_WORDS = "http https www com html page index image file path home user data test example lorem ipsum".split()
#: Words next to a value that name a credential.
NAMING = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|credential|private|auth|bearer)"
FEATURES = ("length", "transitions", "digits", "uppers", "lowers", "distinct", "coverage", "in_path", "named", "assigned", "quoted", "separators")

#: Candidates that hold one of these are secret.
KNOWN_FORMS = r"(?<![A-Za-z0-9])((AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(live|test)_[A-Za-z0-9]{20,})(?![A-Za-z0-9])"
#: Candidates of these forms are not, unless a credential's name precedes them: identifiers, and what stands behind these words.
IDENTIFIER = r"^\{?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
DIGEST_OR_DATA = r"(?i)((sha-?[0-9]{1,3}|md5|commit|revision|checksum|digest|etag|integrity|uuid|guid|build)[\"'`]?[\s:=-]{1,3}[\"'`]?|;base64,)$"
PATH = r"(?i)(https?://|[a-z0-9_]/)\S*$"
#: A letter beside a digit, or a capital after a small letter; words and numbers, also joined by separators, have neither.
MIXED = r"[A-Za-z][0-9]|[0-9][A-Za-z]|[a-z][A-Z]"


def split_at_candidates(docs: DataFrame) -> DataFrame:
    """Adds ``_found``, the candidates of ``text`` in order, and ``_gaps``, what stands before, between and after them."""
    found = F.coalesce(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), F.array().cast("array<string>"))
    return docs.withColumn("_found", found).withColumn("_gaps", F.when(F.size("_found") > 0, F.split("text", CANDIDATE, -1)))


def _contexts() -> Column:
    """``found``, ``left`` and ``right`` of each candidate: the text beside it, other candidates in it included."""
    gap, found = (lambda i: F.coalesce(F.get("_gaps", i), F.lit(""))), (lambda i: F.coalesce(F.get("_found", i), F.lit("")))
    reach = range(CONTEXT // (SHORTEST + 1), 0, -1)

    def beside(x: Column, i: Column) -> Column:
        before = [piece for j in reach for piece in (F.right(gap(i - j), F.lit(CONTEXT)), F.right(found(i - j), F.lit(CONTEXT)))]
        after = [piece for j in reversed(reach) for piece in (F.left(found(i + j), F.lit(CONTEXT)), F.left(gap(i + j + 1), F.lit(CONTEXT)))]
        left, right = F.concat(*before, F.right(gap(i), F.lit(CONTEXT))), F.concat(F.left(gap(i + 1), F.lit(CONTEXT)), *after)
        return F.struct(x.alias("found"), F.right(left, F.lit(CONTEXT)).alias("left"), F.left(right, F.lit(CONTEXT)).alias("right"))

    return F.transform("_found", beside)


def has_form(found: Column, left: Column, right: Column) -> Column:
    """Whether a candidate is of a form that only secrets have: a vendor's, a random-looking value assigned to a
    credential's name or borne in a header, or a URL's password."""
    one_piece, digit = ~F.regexp_like(found, F.lit(r"\s")), F.regexp_like(found, F.lit("[0-9]"))
    long = F.length(found) >= 16
    assigned = F.regexp_like(left, F.lit(f"({ASSIGNMENT})$")) & (long | F.regexp_like(found, F.lit("[A-Za-z]")))
    borne = F.regexp_like(left, F.lit(f"({BEARER})$")) & long
    in_url = F.regexp_like(left, F.lit(f"({URL_USER})$")) & F.startswith(right, F.lit("@"))
    return F.regexp_like(found, F.lit(KNOWN_FORMS)) | (one_piece & ((digit & (assigned | borne)) | in_url))


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.length(text)


def common_words(docs: DataFrame, at_most: int = DICTIONARY_WORDS) -> list[str]:
    """The most frequent words of three letters and more of all texts; ties go to the first in order."""
    words = docs.select(F.explode(words_array(F.lower("text"))).alias("w")).where(F.regexp_like("w", F.lit("^[a-z]{3,24}$")))
    top = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "w").limit(at_most)
    return [r["w"] for r in top.collect()]


def features(found: Column, left: Column, right: Column, dictionary: Sequence[str] = ()) -> Column:
    """The features of one candidate as an array of doubles, in the order of ``FEATURES``."""
    near_left, near_right = F.right(left, F.lit(CONTEXT)), F.left(right, F.lit(CONTEXT))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(found, "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "a")
    # a class change lies between two neighbours of different class
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1
    uncovered = F.length(F.regexp_replace(F.lower(found), "(" + "|".join(sorted({*dictionary, *WEB_WORDS}, key=lambda w: (-len(w), w))) + ")", ""))
    n = F.length(found)
    values = (
        n, runs / n, _share(found, "[0-9]"), _share(found, "[A-Z]"), _share(found, "[a-z]"), F.size(F.array_distinct(F.split(found, ""))) / n, 1 - uncovered / n,
        (F.contains(found, F.lit("/")) | F.regexp_like(near_left, F.lit(r"(://|[/.@\\])\S*$"))).cast("int"),
        F.regexp_like(near_left, F.lit(NAMING)).cast("int"),
        F.regexp_like(near_left, F.lit(r"[=:]\s*[\"']?$")).cast("int"),
        (F.regexp_like(near_left, F.lit(r"[\"'`]$")) & F.regexp_like(near_right, F.lit(r"^[\"'`]"))).cast("int"),
        _share(found, "[+/_=-]"),
    )
    return F.array(*[v.cast("double") for v in values])


def _candidates(parts: DataFrame) -> DataFrame:
    """One row a candidate: ``found``, ``left``, ``right``."""
    return parts.where(F.size("_found") > 0).select(F.explode(_contexts()).alias("at")).select("at.found", "at.left", "at.right")


def findings_by_form(docs: DataFrame, at_most: int = TRAIN_FINDINGS) -> DataFrame:
    """Labelled findings ``(found, left, right, secret)`` from documents, for want of hand-made ones.

    Candidates of a secret's form are secret.  Words and numbers that no credential's name precedes are not, nor are identifiers, digests,
    inline data and parts of addresses, which look as random as secrets do.  What others are is not known, so nothing is learnt from
    them.  Of each kind about half of ``at_most`` are drawn, by a hash of the candidate.  Null and empty texts hold no
    candidate; equal findings count once; an empty table gives no finding."""
    rows = _candidates(split_at_candidates(docs.select("text"))).distinct()
    beside = F.col("found"), F.col("left"), F.col("right")
    plain = ~F.regexp_like("found", F.lit(MIXED)) | F.regexp_like("found", F.lit(IDENTIFIER)) | F.regexp_like("left", F.lit(DIGEST_OR_DATA)) | F.regexp_like("left", F.lit(PATH))
    harmless = plain & ~F.regexp_like("left", F.lit(NAMING))
    rows = rows.withColumn("secret", F.when(has_form(*beside), 1).when(harmless, 0)).where("secret IS NOT NULL")
    rows = keep(rows, "secret-findings")
    counts = {r["secret"]: r["count"] for r in rows.groupBy("secret").count().collect()}
    draw = F.pmod(F.xxhash64("found", "left", F.lit(23)), F.lit(1_000_000))
    limit = {k: int(1_000_000 * min(1.0, at_most / 2 / n)) for k, n in counts.items()}
    return rows.where(draw < F.when(F.col("secret") == 1, limit.get(1, 0)).otherwise(limit.get(0, 0)))


def _tree_sql(lines: list[str]) -> str:
    """The CASE expression of one tree, from Spark's own description of it."""
    line = lines.pop(0).strip()
    if leaf := re.match(r"Predict: (\S+)", line):
        return leaf[1]
    feature, cut = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low = _tree_sql(lines)
    lines.pop(0)  # Else
    high = _tree_sql(lines)
    return f"CASE WHEN c.f[{feature}] <= {cut}D THEN {low} ELSE {high} END"


class Forest:
    """Votes of a random forest as a SQL expression over a candidate ``c`` with its features ``c.f``."""

    def __init__(self, findings: DataFrame, dictionary: Sequence[str] = (), trees: int = TREES, depth: int = DEPTH, seed: int = 5):
        self.dictionary = tuple(dictionary)
        rows = keep(findings.select(features(F.col("found"), F.col("left"), F.col("right"), self.dictionary).alias("f"), F.col("secret").cast("double").alias("label")), "secret-features")
        counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        if len(counts) < 2:  # nothing to tell apart: every candidate is what all findings are, or, without any, suspect
            self.votes = f"{next(iter(counts), 1.0)}D"
            return
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=64).fit(rows.select(array_to_vector("f").alias("features"), "label"))
        sums = [_tree_sql(tree.toDebugString.split("\n")[1:]) for tree in model.trees]
        self.votes = "(" + " + ".join(sums) + f") / {len(sums)}D"

    def mark(self, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
        """Adds ``_found``, ``_gaps`` and ``_secret``, one flag a candidate."""
        parts = split_at_candidates(docs)
        judge = lambda c: F.struct(has_form(c["found"], c["left"], c["right"]).alias("form"), features(c["found"], c["left"], c["right"], self.dictionary).alias("f"))
        secret = F.expr(f"transform(_judged, c -> c.form OR {self.votes} >= {threshold}D)")
        none = F.array().cast("array<struct<form:boolean,f:array<double>>>")
        judged = F.when(F.size("_found") > 0, F.transform(_contexts(), judge)).otherwise(none)
        return parts.withColumn("_judged", judged).withColumn("_secret", secret).drop("_judged")


def _running(lengths: Column, first: Column) -> Column:
    """``first`` and its sums with the lengths, one by one, but for the last."""
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts"))
    empty = F.struct(first.cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    return F.aggregate(lengths, empty, step, lambda acc: acc["starts"])


def _positions() -> Column:
    """Start of each candidate in the text, from the lengths of gaps and candidates before it; in blocks, as appending copies."""
    block = 128
    lengths = F.transform("_found", lambda x, i: (F.length(F.get("_gaps", i)) + F.length(x)).cast("long"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_found") - 1) / block).cast("int")), lambda b: F.slice(lengths, b * block + 1, block))
    sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y))
    starts = F.flatten(F.zip_with(blocks, _running(sums, F.lit(0)), _running))
    return F.transform(starts, lambda x, i: (x + F.length(F.get("_gaps", i))).cast("int"))


def scan(docs: DataFrame, forest: Forest) -> DataFrame:
    """Secrets of every whole text.

    Input: ``doc_id``, ``text``; other columns are ignored.  Output: ``doc_id``, ``n_candidates``, ``n_secrets``, ``spans`` (start and
    length in characters of each secret).

    Null and empty texts hold nothing.  Rows are independent of each other, so repeated rows, null ids and
    empty tables need no rule of their own.
    """
    rows = forest.mark(docs.select("doc_id", "text"))
    hits = F.filter(F.arrays_zip(_positions().alias("start"), F.transform("_found", F.length).alias("length"), F.col("_secret").alias("secret")), lambda x: x["secret"])
    spans = F.transform(hits, lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    none = F.array().cast("array<struct<start:int,length:int>>")
    return rows.select(
        "doc_id", F.size("_found").cast("long").alias("n_candidates"), F.size(F.filter("_secret", lambda s: s)).cast("long").alias("n_secrets"),
        F.when(F.exists("_secret", lambda s: s), spans).otherwise(none).alias("spans"),
    )


def redacted(docs: DataFrame, forest: Forest, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``; all rows and columns stay, whatever their names.

    Null and empty texts stay as they are; equal rows get equal texts; an empty table gives an empty result."""
    own = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    pieces = F.transform("_gaps", lambda gap, i: F.concat(gap, F.when(F.coalesce(F.get("_secret", i), F.lit(False)), F.lit(mask)).otherwise(F.coalesce(F.get("_found", i), F.lit("")))))
    text = F.when(F.exists("_secret", lambda s: s), F.array_join(pieces, "")).otherwise(F.col("text"))
    rows = forest.mark(own).select("_row", text.alias("_text"))
    return rows.select(*[F.col("_text").alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])


def op4_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scan(docs, Forest(findings_by_form(docs), common_words(docs)))
