"""Text rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefit import fixed as fx

UNICODE = "(?U)"


def strip_xref(name: Column) -> Column:
    return F.substring_index(name, "|", -1)


def fold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ё"), F.lit("е"))


def normalize_layer(name: Column) -> Column:
    return F.trim(F.regexp_replace(fold(name), r"[\s_\-$/\\.,()\[\]|]+", " "))


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(UNICODE + pattern)


def any_of(patterns) -> str:
    return "|".join(patterns)


def classify(name: Column) -> tuple[Column, Column]:
    """(kind, object_type) by the first matching rule; null for annotation layers and unknown names."""
    text = normalize_layer(name)
    veto = (text == "") | matches(text, any_of(fx.ANNOTATION_PATTERNS))
    hits = [matches(text, r[0]) for r in fx.LAYER_RULES]
    pick = lambda k: F.when(~veto, F.coalesce(*[F.when(h, F.lit(r[k])) for h, r in zip(hits, fx.LAYER_RULES)]))
    return pick(1), pick(2)


def is_symbol(name: Column) -> Column:
    return name.isin(list(fx.SYMBOL_LAYERS)) | matches(normalize_layer(name), any_of(fx.SYMBOL_PATTERNS))


def resolve_layer(name: Column) -> tuple[Column, Column]:
    """Exact map first, then the rules, then (zone, unknown)."""
    bare = strip_xref(name)
    kind, kind_type = classify(bare)
    exact = lambda k: F.create_map(*[F.lit(v) for r in fx.LAYER_MAP for v in (r[0], r[k])])[bare]
    return F.coalesce(exact(1), kind, F.lit("zone")), F.coalesce(exact(2), kind_type, F.lit("unknown"))


def species_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(fold(name), r"\s+", " "))


def normalize_message(text: Column) -> Column:
    """Lower case, plain е, decimal point, ``3-д`` as ``3d``."""
    out = F.regexp_replace(fold(text), r"(?<=[0-9]),(?=[0-9])", ".")
    return F.regexp_replace(out, UNICODE + r"\b([23])\s*-?\s*[dд]\b", "$1d")


def words(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit("([a-zа-я]+)"), F.lit(1))


def stem(word: Column) -> Column:
    """Rough stem: the first listed ending that leaves at least three letters."""
    cuts = [F.when(word.endswith(e) & (F.length(word) - len(e) >= 3), F.substring(word, F.lit(1), F.length(word) - len(e))) for e in fx.STEM_ENDINGS]
    return F.coalesce(*cuts, word)


def first_rule(text: Column, rules) -> Column:
    return F.coalesce(*[F.when(matches(text, p), F.lit(v)) for p, v in rules])


def clauses(messages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Clauses of each message in order, each with its "asked" flag.

    A relative clause is joined to the clause before it; a sentence with a question mark or an asking phrase
    marks all of its clauses.
    """
    c = F.col
    from pyspark.sql import Window as W

    guarded = F.regexp_replace(normalize_message(c(text)), r"\.([0-9])", "\u0002$1")
    marked = F.regexp_replace(guarded, r"([!?\n.])", "$1\u0001")
    rows = messages.select(*keys, F.posexplode(F.split(marked, "\u0001")).alias("sentence", "body"))
    parts = rows.select(*keys, "sentence", "body", F.posexplode(F.split(F.concat(F.lit(" "), "body", F.lit(" ")), fx.CLAUSE_BREAK)).alias("part", "raw"))
    clean = F.regexp_replace(c("raw"), "[^\\p{L}\\p{N}_\\s\u0002]", " ")
    clean = F.regexp_replace(clean, "(^|[^0-9])\u0002", "$1 ")
    clean = F.trim(F.regexp_replace(F.regexp_replace(clean, r"\s+", " "), "\u0002", "."))
    parts = parts.withColumn("clause", clean).filter(c("clause") != "")
    here = W.partitionBy(*keys, "sentence")
    asked = c("body").contains("?") | F.max(matches(c("clause"), fx.ASKING)).over(here)
    order = W.partitionBy(*keys).orderBy("sentence", "part").rowsBetween(W.unboundedPreceding, 0)
    own = (~matches(c("clause"), fx.RELATIVE_CLAUSE)).cast("int")
    parts = parts.withColumn("asked", asked).withColumn("no", F.greatest(F.sum(own).over(order), F.lit(1)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence", "part", "clause"))), lambda s: s["clause"]), " ")
    return parts.groupBy(*keys, "no").agg(joined.alias("clause"), F.bool_or("asked").alias("asked")).withColumn("no", c("no").cast("long"))


def typo_fixes(messages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Words one edit or one swap away from a known word with the same first letter, and what they become."""
    c = F.col
    spark = messages.sparkSession
    from sitefit.functions.dims import dim

    tokens = messages.select(*keys, F.explode(F.regexp_extract_all(normalize_message(c(text)), F.lit("([а-я]{5,})"), F.lit(1))).alias("word"))
    known = c("word").isin(list(fx.TYPO_TARGETS + fx.TYPO_KNOWN))
    for p in fx.TYPO_KNOWN_PREFIXES:
        known = known | c("word").startswith(p)
    counted = tokens.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    vocabulary = counted.filter(~known).select("word").distinct()
    targets = dim(spark, [(w, i, w[0]) for i, w in enumerate(fx.TYPO_TARGETS)], "target,priority,first")
    w = c("word")
    swap = F.exists(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.concat(
        F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.lit(1)), F.substring(w, i, F.lit(1)), F.substring(w, i + 2, F.length(w))) == c("target"))
    near = (F.levenshtein("word", "target") == 1) | ((F.length("word") == F.length("target")) & swap)
    fixes = (vocabulary.withColumn("first", F.substring("word", 1, 1)).join(F.broadcast(targets), "first").filter(near)
             .groupBy("word").agg(F.min_by("target", "priority").alias("fixed")))
    return counted.join(fixes, "word").select(*keys, "word", "fixed", "n")
