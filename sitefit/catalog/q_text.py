"""Text-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitefit import fixed as fx
from sitefit.catalog.q_scalars import KEY
from sitefit.catalog.registry import query
from sitefit.catalog.sqlkit import cte, lit, re2, sql, values, wide
from sitefit.functions import text as tx
from sitefit.functions.intents import INTENT_RULES
from sitefit.operators import messages as ms

W = r"[^\p{L}\p{N}_]"
LOWER = "replace(lower(text), 'ё', 'е')"
DEC = r"regexp_replace(regexp_replace(" + LOWER + r", '([0-9]),([0-9])', '\1.\2', 'g'), '([0-9]),([0-9])', '\1.\2', 'g')"
cte("norm_msgs", rf"SELECT conv_id, turn, role, regexp_replace({DEC}, '(^|{W})([23])\s*-?\s*[dд]($|{W})', '\1\2d\3', 'g') AS body FROM utterances")


@query("normalize_text", sql("SELECT conv_id, turn, body FROM norm_msgs"))
def normalize_text(t):
    """Messages in lower case, plain е, decimal points."""
    return t.utterances.select("conv_id", "turn", tx.normalize_message(F.col("text")).alias("body"))


cte("d_typo", values([(w, i) for i, w in enumerate(fx.TYPO_TARGETS)], "target,priority"))
KNOWN_WORDS = ", ".join(lit(w) for w in fx.TYPO_TARGETS + fx.TYPO_KNOWN)
PREFIX = " OR ".join(f"starts_with(word, {lit(p)})" for p in fx.TYPO_KNOWN_PREFIXES)


def shorter(a: str, b: str) -> str:
    return f"len(list_filter(range(1, length({b}) + 1), lambda i: concat(substr({b}, 1, i - 1), substr({b}, i + 1)) = {a})) > 0"


SWAPPED = "concat(substr(word, 1, i - 1), substr(word, i + 1, 1), substr(word, i, 1), substr(word, i + 2))"
ONE_EDIT = f"""CASE length(word) - length(target) WHEN 0 THEN len(list_filter(range(1, length(word) + 1), lambda i: substr(word, i, 1) <> substr(target, i, 1))) = 1
    OR (word <> target AND len(list_filter(range(1, length(word)), lambda i: {SWAPPED} = target)) > 0) WHEN 1 THEN {shorter('target', 'word')} WHEN -1 THEN {shorter('word', 'target')} ELSE FALSE END"""


@query("fix_typos", sql(f"""SELECT w.conv_id, w.turn, w.word, f.fixed, w.n FROM (SELECT conv_id, turn, word, count(*)::BIGINT AS n FROM (
    SELECT conv_id, turn, unnest(regexp_extract_all(body, '[а-я]{{5,}}')) AS word FROM norm_msgs) q GROUP BY ALL) w
  JOIN (SELECT word, arg_min(target, priority) AS fixed FROM (SELECT DISTINCT unnest(regexp_extract_all(body, '[а-я]{{5,}}')) AS word FROM norm_msgs) v
    JOIN d_typo ON substr(word, 1, 1) = substr(target, 1, 1) AND {ONE_EDIT} WHERE word NOT IN ({KNOWN_WORDS}) AND NOT ({PREFIX}) GROUP BY word) f USING (word)"""))
def fix_typos(t):
    """Misspelt planting words and their correction."""
    return tx.typo_fixes(t.utterances, ["conv_id", "turn"])


def hit(expr: str, pattern: str) -> str:
    return f"regexp_matches({wide(expr)}, {lit(re2(pattern))})"


cte("sentences", r"""SELECT conv_id, turn, s.i AS sentence, s.body FROM (SELECT conv_id, turn, unnest(list_zip(range(len(p)), p)) AS z FROM (
    SELECT conv_id, turn, string_split(regexp_replace(regexp_replace(body, '\.([0-9])', chr(2) || '\1', 'g'), '([!?\n.])', '\1' || chr(1), 'g'), chr(1)) AS p FROM norm_msgs) a) b,
  LATERAL (SELECT z[1] AS i, z[2] AS body) s""")
cte("parts", rf"""SELECT * FROM (SELECT conv_id, turn, sentence, body, z[1] AS part,
    trim(replace(regexp_replace(regexp_replace(regexp_replace(z[2], '[^\p{{L}}\p{{N}}_\s' || chr(2) || ']', ' ', 'g'), '(^|[^0-9])' || chr(2), '\1 ', 'g'), '\s+', ' ', 'g'), chr(2), '.')) AS clause
  FROM (SELECT conv_id, turn, sentence, body, unnest(list_zip(range(len(p)), p)) AS z FROM (SELECT *, regexp_split_to_array(concat(' ', body, ' '), {lit(fx.CLAUSE_BREAK)}) AS p FROM sentences) a) b) c WHERE clause <> ''""")
cte("clause_rows", f"""SELECT conv_id, turn, no::BIGINT AS no, string_agg(clause, ' ' ORDER BY sentence, part) AS clause, bool_or(asked) AS asked FROM (
    SELECT *, greatest(sum(CASE WHEN {hit('clause', fx.RELATIVE_CLAUSE)} THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn ORDER BY sentence, part ROWS UNBOUNDED PRECEDING), 1) AS no,
      contains(body, '?') OR bool_or({hit('clause', fx.ASKING)}) OVER (PARTITION BY conv_id, turn, sentence) AS asked FROM parts) q GROUP BY conv_id, turn, no""")


@query("split_clauses", sql("SELECT * FROM clause_rows"))
def split_clauses(t):
    """Clauses of every message with their "asked" flag."""
    return tx.clauses(t.utterances, ["conv_id", "turn"])


INTENT = "CASE " + " ".join(f"WHEN {hit('clause', p)} THEN {lit(v)}" for p, v in INTENT_RULES) + " END"
cte("intent_rows", f"SELECT conv_id, turn, no, clause, asked, {INTENT} AS intent FROM clause_rows")


@query("tag_intents", sql("SELECT conv_id, intent, count(*)::BIGINT AS clauses, count(*) FILTER (asked)::BIGINT AS asked FROM intent_rows WHERE intent IS NOT NULL GROUP BY ALL"))
def tag_intents(t):
    """Intents per conversation, by ordered rules over clauses."""
    rows = ms.intents(tx.clauses(t.utterances, ["conv_id", "turn"]))
    return rows.filter("intent is not null").groupBy("conv_id", "intent").agg(F.count(F.lit(1)).alias("clauses"), F.sum(F.col("asked").cast("long")).alias("asked"))


def stem_sql(w: str) -> str:
    return "CASE " + " ".join(f"WHEN suffix({w}, {lit(e)}) AND length({w}) - {len(e)} >= 3 THEN substr({w}, 1, length({w}) - {len(e)})" for e in fx.STEM_ENDINGS) + f" ELSE {w} END"


WORDS = "regexp_extract_all(replace(lower({}), 'ё', 'е'), '[a-zа-я]+')"
cte("cat_stems", f"SELECT name, pos, {stem_sql('w')} AS stem FROM (SELECT name, unnest(range(len(ws))) AS pos, unnest(ws) AS w FROM (SELECT name, {WORDS.format('name')} AS ws FROM d_species) a) b")
cte("ask_stems", f"SELECT DISTINCT k, pos, {stem_sql('w')} AS stem FROM (SELECT k, unnest(range(len(ws))) AS pos, unnest(ws) AS w FROM (SELECT k, {WORDS.format('name')} AS ws FROM species_names) a) b")


@query("match_names", sql(f"""SELECT k, name AS species, row_number() OVER (PARTITION BY k ORDER BY exact DESC, score DESC, name)::BIGINT AS rank, score::BIGINT AS score FROM (
    SELECT *, max(exact) OVER (PARTITION BY k) AS any_exact FROM (SELECT a.k, c.name, count(DISTINCT a.pos) AS score, bool_or(c.pos = 0) AS genus,
      any_value(array_to_string({WORDS.format('n.name')}, ' ') = array_to_string({WORDS.format('c.name')}, ' '))::INT AS exact
    FROM ask_stems a JOIN species_names n USING (k) JOIN cat_stems c ON least(length(a.stem), length(c.stem)) >= 3 AND (starts_with(a.stem, c.stem) OR starts_with(c.stem, a.stem)) GROUP BY a.k, c.name) q WHERE genus) r
  WHERE exact = any_exact"""))
def match_names(t):
    """Catalogue names similar to a written one: the genus must match, an exact name wins."""
    return ms.match_names(t.species_names)


@query("batch_guard", sql("""SELECT m.conv_id, m.turn, m.no, CASE WHEN m.picks THEN 'after_select' WHEN m.selected <= 0 THEN 'nothing_selected' WHEN m.clears THEN 'with_deselect' WHEN m.asked THEN 'asked' ELSE 'kept' END AS reason
  FROM (SELECT conv_id, turn, no, intent, asked, bool_or(intent = 'select') OVER w AS picks, bool_or(intent = 'deselect') OVER w AS clears, conv_id % 4 AS selected FROM intent_rows WHERE intent IS NOT NULL
    WINDOW w AS (PARTITION BY conv_id, turn)) m WHERE m.intent = 'delete'"""))
def batch_guard(t):
    """Destructive commands that must not run, with the reason."""
    rows = ms.intents(tx.clauses(t.utterances, ["conv_id", "turn"])).withColumn("selected", F.col("conv_id") % 4)
    return ms.guard(rows)
