"""Secret scans: candidate strings in texts, and a random forest that removes false positives.

Candidates are runs of 16 or more key characters and dots that are no plain words: a digit or both cases among letters. They begin after any
other sign ('=', ':', '?', '@', a quote), and dotted parts stay together. Each has features of its own (length, entropy-like share of different characters, transitions between character classes, shares of digits, upper case and
hexadecimal digits), its dictionary coverage (share of its characters in runs of letters that are common words of the corpus), its path
(the row's source, path marks in the string or just before it, a file's or host's ending, a mail address), and its neighbours (an assignment, a quote, words that announce keys
or that announce something else). A random forest trained on labelled findings scores them.

DataFrame functions and the JVM forest of pyspark.ml only.

Scale: one pass extracts candidates, one row each with a short context; the dictionary is at most DICTIONARY frequent words, counted over
all texts and broadcast; the forest is fitted on at most FIT_ROWS labelled findings. No text is shuffled by the scan.

Nulls, empty and odd input: null and empty texts have no candidates. Candidates of rows with a null id are found and scored. Repeated rows
give repeated findings. Columns other than the id, the text and the source are never read. With findings of one label only, or
none, the rule that labels them decides. An empty table gives no rows. Texts are read and candidates are measured whole.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefit.llm.base import once
from sitefit.session import cut

#: Frequent words that count as dictionary, labelled findings a forest is fitted on: at most.
DICTIONARY, FIT_ROWS = 5000, 20_000
#: Words of the text that announce a key, and words that announce something that looks like one.
ANNOUNCE = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|bearer|credential|client.?id)"
DISCLAIM = r"(?i)(sha1|sha256|md5|checksum|commit|digest|hash|uuid|guid|example|sample|dummy|test|isbn|phone|card|order|invoice)"
#: A stretch between blanks that may hold a candidate, and in it a candidate after whatever stands before it, and the sign @ after it.
MAYBE = r"[A-Za-z0-9+/_.-]{16}"
CANDIDATE = r"(?s)\G.*?[A-Za-z0-9+/_.-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_.=-]))?@?"
_KEY = r"([A-Za-z0-9+/_.-]{16,}+={0,2})@?$"
#: What a candidate doesn't begin or end with.
_EDGE = r"^(?:\.|//)+|\.+$"

FEATURES = ("length", "distinct", "changes", "digits", "upper", "hexadecimal", "coverage", "path", "assigned", "quoted", "announced", "disclaimed")


def frequent_words(docs: DataFrame, most: int = DICTIONARY) -> DataFrame:
    """(word): the most frequent lower-case words of four letters or more, by documents that have them."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda w: F.length(w) >= 4))
    found = docs.select(F.explode(words).alias("word")).filter(F.length("word") <= 24)
    return found.groupBy("word").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "word").limit(most).select("word")


def candidates(docs: DataFrame, source: str = "source") -> DataFrame:
    """(doc_id, source, candidate, before, after): every candidate, with the three words before it and what its own word begins with, and a following @."""
    c = F.col
    place = c(source).cast("string") if source in docs.columns else F.lit(None).cast("string")
    rows = once(docs.select(c("doc_id").cast("long").alias("doc_id"), place.alias("source"), "text"), words=F.split(F.coalesce("text", F.lit("")), r"[ \t\r\n]+")).drop("text")
    at = F.filter(F.transform("words", lambda w, k: F.when((F.length(w) >= 16) & w.rlike(MAYBE), k)), lambda k: k.isNotNull())
    near = F.transform(at, lambda k: F.struct(F.get("words", k).alias("word"), F.concat_ws(" ", *[F.get("words", k - j) for j in (3, 2, 1)]).alias("near")))
    rows = once(rows.select("doc_id", "source", F.inline(near)), pieces=F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0)))
    # what stands before a candidate begins with the candidate before it, which may be the name it is assigned to
    pieces = F.transform("pieces", lambda piece, k: F.struct(piece.alias("found"), F.when(k > 0, F.get("pieces", k - 1)).otherwise(F.lit("")).alias("former")))
    rows = once(rows.select("doc_id", "source", "near", F.inline(pieces)), key=F.regexp_extract("found", _KEY, 1))
    rows = once(rows, candidate=F.regexp_replace("key", _EDGE, ""))
    lead = F.expr("substring(found, 1, length(found) - length(key) - int(found like '%@'))")
    rows = rows.withColumn("before", F.concat("near", F.lit(" "), "former", lead, F.regexp_extract("key", r"^(?:\.|//)*", 0)))
    rows = rows.withColumn("after", F.when(c("found").endswith("@"), F.lit("@")).otherwise(F.lit("")))
    mixed = c("candidate").rlike("[0-9]") | (c("candidate").rlike("[a-z][A-Z]") & c("candidate").rlike("^[^A-Z]*+[A-Z][^a-z]*+[a-z][^A-Z]*+[A-Z]"))
    return rows.filter((F.length("candidate") >= 16) & mixed).select("doc_id", "source", "candidate", "before", "after")


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.length(text)


def measured(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Candidates with their features; each different string is looked up in the dictionary once."""
    c = F.col
    word = c("candidate")
    after = c("after") if "after" in found.columns else F.lit("")
    # a mail address, but not a key before the host of a link
    mail = ((after == "@") & ~c("before").rlike("(//|:)$")) | (c("before").endswith("@") & c("candidate").contains("."))
    letters = F.filter(F.split(F.lower(F.regexp_replace(word, "(?<=[a-z])(?=[A-Z])", " ")), "[^a-z]+"), lambda w: F.length(w) >= 4)
    parts = found.select("candidate").distinct().select("candidate", F.explode(letters).alias("word"))
    covered = parts.join(F.broadcast(dictionary), "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("covered_"))
    rows = found.join(covered, "candidate", "left").withColumn("coverage", F.coalesce("covered_", F.lit(0)) / F.length(word)).drop("covered_")
    kinds = F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "A" * 26 + "a" * 26 + "0" * 10)
    return rows.withColumns({
        "length": F.length(word).cast("double"),
        "distinct": F.size(F.array_distinct(F.split(word, ""))) / F.length(word),
        "changes": F.length(F.regexp_replace(kinds, r"(.)\1*", "x")) / F.length(word),
        "digits": _share(word, "[0-9]"), "upper": _share(word, "[A-Z]"), "hexadecimal": _share(word, "[0-9a-fA-F]"),
        "path": (c("candidate").rlike("/[^/]*+/") | c("candidate").rlike(r"[.][A-Za-z][A-Za-z0-9]{0,5}(/|$)") | (c("before").rlike(r"(https?:|[/\\.])$") & (after != "@")) | mail
                 | F.coalesce(c("source").rlike(r"(?i)(test|example|fixture|mock)"), F.lit(False))).cast("double"),
        "assigned": c("before").rlike(r"[=:]\s*[\"']?$").cast("double"), "quoted": c("before").rlike("[\"']$").cast("double"),
        "announced": c("before").rlike(ANNOUNCE).cast("double"), "disclaimed": c("before").rlike(DISCLAIM).cast("double")})


def rule_labels(rows: DataFrame) -> DataFrame:
    """Findings that leave little doubt, labelled by rule: `secret` 1 or 0. Others are left out.

    A random string that is announced and assigned is a secret; numbers, words joined together, paths and strings announced as something
    else are none.
    """
    c = F.col
    # few different characters are no sign against a long string; keys in capitals and digits change seldom
    varied = c("distinct") * c("length") > F.least(F.lit(0.2) * c("length"), F.lit(20.0))
    capitals = (c("upper") + c("digits") > 0.999) & (c("digits") > 0) & (c("upper") > 0) & (c("distinct") > 0.5)
    random = varied & (c("coverage") < 0.4) & ((c("changes") > 0.25) | capitals)
    positive = (c("announced") == 1) & (c("assigned") == 1) & (c("disclaimed") == 0) & random
    negative = (c("digits") == 1) | (c("coverage") >= 0.5) | (c("path") == 1) | ((c("disclaimed") == 1) & (c("announced") == 0)) | ((c("changes") < 0.1) & ~capitals)
    return rows.withColumn("secret", F.when(positive, 1.0).when(negative, 0.0)).filter("secret is not null")


def forest(labelled: DataFrame, fit_rows: int = FIT_ROWS):
    """A random forest on labelled findings (features and `secret`), None if they have one label only.

    At most about `fit_rows` are used, chosen by a hash of the string. Half of them are shown once more without what announces
    or assigns them, so the forest learns the strings too.
    """
    c = F.col
    n = labelled.count()
    share = int(1_000_003 * min(1.0, fit_rows / max(n, 1)))
    fitted = labelled.filter(F.pmod(F.xxhash64("candidate"), F.lit(1_000_003)) < share).select(*FEATURES, "secret", F.pmod(F.xxhash64("candidate", F.lit(3)), F.lit(2)).alias("half"))
    bare = fitted.filter("half = 0").withColumns({k: F.lit(0.0) for k in ("assigned", "quoted", "announced")})
    fitted = cut(fitted.unionByName(bare))
    if fitted.select("secret").distinct().count() < 2:
        return None
    return RandomForestClassifier(featuresCol="features", labelCol="secret", numTrees=30, maxDepth=6, seed=5).fit(_assembled(fitted))


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(rows)


def findings(docs: DataFrame, labelled: DataFrame | None = None, source: str = "source", threshold: float = 0.5) -> DataFrame:
    """(doc_id, candidate, before, features, score, secret): all candidates with the chance that they are secrets.

    `labelled` has the features' inputs (source, candidate, before, and after if it is known) and `secret`; by default the corpus' own findings are labelled by rule.
    """
    c = F.col
    dictionary = cut(frequent_words(docs))
    rows = cut(measured(candidates(docs, source), dictionary))
    train = rule_labels(rows) if labelled is None else measured(labelled, dictionary)
    model = forest(train)
    if model is None:
        ruled = rule_labels(rows).select("candidate", "before", "secret").distinct()
        found = rows.join(ruled, ["candidate", "before"], "left").withColumn("score", F.coalesce("secret", F.lit(0.0))).drop("secret")
    else:
        scored = model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("chance_").transform(_assembled(rows))
        found = scored.withColumn("score", vector_to_array("chance_")[1]).drop("chance_", "features")
    return found.withColumn("secret", c("score") >= threshold)


def counted(docs: DataFrame, source: str = "source") -> DataFrame:
    """(doc_id, n_candidates, n_secrets, top_score) of every row's id."""
    found = findings(docs, source=source).groupBy("doc_id").agg(
        F.count("*").alias("n_candidates"), F.count_if("secret").alias("n_secrets"), F.max("score").alias("top_score"))
    zero = F.lit(0).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(found.withColumnRenamed("doc_id", "id_"), F.col("doc_id").eqNullSafe(F.col("id_")), "left").select(
        "doc_id", F.coalesce("n_candidates", zero).alias("n_candidates"), F.coalesce("n_secrets", zero).alias("n_secrets"), F.coalesce("top_score", F.lit(0.0)).alias("top_score"))


def redacted(docs: DataFrame, source: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every secret's string replaced by a mark; all rows and columns stay."""
    c = F.col
    found = findings(docs, source=source).filter("secret").groupBy(c("doc_id").alias("id_")).agg(F.array_sort(F.collect_set("candidate"), lambda a, b: F.length(b) - F.length(a)).alias("secrets_"))
    rows = docs.join(found, c("doc_id").cast("long").eqNullSafe(c("id_")), "left")
    clean = F.aggregate(F.coalesce("secrets_", F.array().cast("array<string>")), c("text"), lambda text, secret: F.replace(text, secret, F.lit(mark)))
    return rows.withColumn("text", clean).select(docs.columns)
