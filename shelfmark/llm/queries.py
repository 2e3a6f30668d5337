"""The operators of this subpackage bound to the test tables, and their SQL where SQL has a form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Folder of the public tokenizer files; its path is a parameter of the operators.
TOKENIZER = "piece_bpe_32k.model"
RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from shelfmark.llm.quality_rules import quality_verdicts

    return quality_verdicts(table(spark, folder, "documents"), table(spark, folder, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def quality_rules_decide(spark: SparkSession, folder: str) -> DataFrame:
    """The rules at 5 % false rejections and 10 % risk: looser bounds certify cutoffs on small tables too."""
    from shelfmark.llm.quality_rules import quality_verdicts

    found = quality_verdicts(table(spark, folder, "documents"), table(spark, folder, "labels"), alpha=0.05, delta=0.1)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from shelfmark.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, folder, "documents"), width=3, num=90, den=100)


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from shelfmark.llm.toxicity import fold, toxicity_scores

    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(True))
    found = toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"), learn=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", "worst_begin", "worst_end", "worst_score", "sentences")


def op4_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from shelfmark.llm.substring_dedup import suffix_dedup

    return suffix_dedup(table(spark, folder, "documents"))


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    from shelfmark.llm.pieces import piece_codes

    return piece_codes(table(spark, folder, "documents"), tokenizer_path())


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from shelfmark.llm.decontamination import benchmark_hits

    return benchmark_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    from shelfmark.llm.quality_ranking import quality_scores
    from shelfmark.llm.toxicity import fold

    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(True))
    found = quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"), learn=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    from shelfmark.llm.main_text import main_texts

    return main_texts(table(spark, folder, "pages"))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from shelfmark.llm.language_net import predicted_languages
    from shelfmark.llm.toxicity import fold

    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(True))
    found = predicted_languages(table(spark, folder, "documents"), learn=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from shelfmark.llm.paragraphs import paragraph_removals

    return paragraph_removals(table(spark, folder, "documents"))


def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    from shelfmark.llm.conversation_trie import conversation_trie

    return conversation_trie(table(spark, folder, "conversations"))


def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from shelfmark.llm.byte_pairs import byte_codes

    return byte_codes(table(spark, folder, "documents"), tokenizer_path(RANKS), public_tokenizers.PATTERN)


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    from shelfmark.llm.ranked_search import ranked_documents

    return ranked_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_decontamination": op6_decontamination,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_html_extraction": op8_html_extraction,
    "op9_language_id": op9_language_id,
    "op10_substring_dedup": op10_substring_dedup,
    "quality_rules_decide": quality_rules_decide,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_ranked_search": op13_ranked_search,
}


def _rules_sql(alpha: float = 0.02, delta: float = 0.05) -> str:
    """The stats by joins over words and lines, the certified cutoffs by summed binomial terms."""
    from shelfmark.llm.quality_rules import CUTOFFS

    cutoffs = ", ".join(f"('{r}', {i}, {c}::DOUBLE)" for r, cs in CUTOFFS.items() for i, c in enumerate(cs))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce('=' || lang, 'null') AS stratum FROM documents),
w AS (SELECT doc_id, stratum, text, regexp_extract_all(text, '[^ 	-
]+') AS words, string_split(text, chr(10)) AS lines FROM d),
pos AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS p, words FROM w WHERE len(words) >= 5),
run AS (SELECT doc_id, p, array_to_string(words[p : p + 4], ' ') AS g FROM pos),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM run) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
s AS (
  SELECT w.doc_id, stratum, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(list_filter(lines, lambda x: regexp_matches(x, '[^ 	-
]')))::BIGINT AS n_lines,
    len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^ 	-
]'))))::BIGINT AS d_lines,
    len(regexp_extract_all(text, '\p{{Lu}}'))::BIGINT AS n_capitals, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)),
v AS (
  SELECT doc_id, stratum, n_words, word_chars, n_symbols, n_lines - d_lines AS n_dup_lines, n_repeat_words,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word,
    CASE WHEN n_lines > 0 THEN (n_lines - d_lines) / n_lines ELSE 0 END AS dup_line_share,
    CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_word_share,
    CASE WHEN word_chars > 0 THEN n_capitals / word_chars ELSE 0 END AS capital_share
  FROM s),
long AS (UNPIVOT (SELECT doc_id, stratum, symbols_per_word, dup_line_share, repeat_word_share, capital_share FROM v)
  ON symbols_per_word, dup_line_share, repeat_word_share, capital_share INTO NAME rule VALUE x),
mark AS (SELECT doc_id, min(quality) > 0 AS good FROM labels GROUP BY doc_id),
cutoff(rule, i, c) AS (VALUES {cutoffs}),
counted AS (
  SELECT stratum, rule, i, c, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE good AND x > c) AS k,
    count(*) FILTER (WHERE NOT good) AS nb, count(*) FILTER (WHERE NOT good AND x > c) AS kb
  FROM long JOIN cutoff USING (rule) LEFT JOIN mark USING (doc_id) GROUP BY ALL),
tail AS (
  SELECT *, CASE WHEN k >= n * {alpha} THEN 1 ELSE
    list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln({alpha}) + (n - j) * ln(1 - {alpha})))) END AS p
  FROM counted),
passed AS (
  SELECT *, min(CASE WHEN n > 0 AND p <= {delta} / ((SELECT count(DISTINCT stratum) FROM d) * 4) THEN 1 ELSE 0 END)
      OVER (PARTITION BY stratum, rule ORDER BY i) AS ok,
    CASE WHEN nb > 0 THEN kb / nb ELSE 0 END - CASE WHEN n > 0 THEN k / n END AS gap
  FROM tail),
chosen AS (
  SELECT stratum, rule, c FROM passed WHERE ok = 1 AND gap > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gap DESC, i) = 1),
hit AS (SELECT DISTINCT doc_id FROM long JOIN chosen USING (stratum, rule) WHERE x > c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM hit) AS kept
FROM v"""


_HITS_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM bw WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM win),
run AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, size WHERE len(w) >= n)),
hit AS (SELECT doc_id, run.n, p, item_id FROM run JOIN win USING (n, g)),
word AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM (SELECT doc_id, p, unnest(range(0, n)) AS k FROM hit) GROUP BY doc_id),
item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)"""


_JOIN_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE
    list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i : i + 2], ' '))) END AS s
  FROM d),
class AS (SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n FROM g WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
tok AS (SELECT rep, n, unnest(s) AS t FROM class),
pair AS (
  SELECT a.rep AS a, b.rep AS b FROM tok a JOIN tok b ON a.t = b.t AND a.rep < b.rep AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
edge AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach(x, y) AS (SELECT rep, rep FROM class UNION SELECT reach.x, edge.b FROM reach JOIN edge ON edge.a = reach.y),
comp AS (SELECT x AS rep, min(y) AS c FROM reach GROUP BY x)
SELECT g.doc_id, len(g.s)::BIGINT AS n_shingles, coalesce(c, g.doc_id) AS component_id
FROM g LEFT JOIN class ON class.s = list_sort(g.s) LEFT JOIN comp USING (rep)"""


_SEARCH_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
total AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
held AS (SELECT * FROM tf WHERE t IN (SELECT t FROM q)),
weight AS (
  SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, total GROUP BY t),
score AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN held USING (t) JOIN weight USING (t), total GROUP BY item_id, r, doc_id),
best AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
  FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM best WHERE rank <= 10"""


#: CRC-32 of the decimal digits of conv_id, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * length(conv_id::VARCHAR))),
    lambda a, k: CASE WHEN (CASE WHEN k % 8 = 0 THEN xor(a, ascii(substr(conv_id::VARCHAR, (k // 8 + 1)::BIGINT, 1))::BIGINT) ELSE a END) & 1 = 1
      THEN xor((CASE WHEN k % 8 = 0 THEN xor(a, ascii(substr(conv_id::VARCHAR, (k // 8 + 1)::BIGINT, 1))::BIGINT) ELSE a END) >> 1, 3988292384::BIGINT)
      ELSE (CASE WHEN k % 8 = 0 THEN xor(a, ascii(substr(conv_id::VARCHAR, (k // 8 + 1)::BIGINT, 1))::BIGINT) ELSE a END) >> 1 END), 4294967295::BIGINT)"""

_TRIE_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, {_CRC} % 4 AS h,
    list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS turns
  FROM t GROUP BY conv_id),
path AS (
  SELECT c.conv_id, list_concat(coalesce(o.turns[1 : c.h], []), c.turns[c.h + 1 :]) AS turns
  FROM c LEFT JOIN c o ON o.conv_id = c.conv_id - c.conv_id % 20),
member AS (SELECT conv_id, len(turns) AS size, depth, turns[1 : depth] AS key FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS depth FROM path)),
node AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256,
    CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(key[-1].text, '[^\x20\x09-\x0D]+')) END AS words
  FROM member GROUP BY depth, key),
kid AS (SELECT key[1 : depth - 1] AS key, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
whole AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kid USING (key)),
up AS (SELECT key[1 : above] AS key, n_children, n_convs, words FROM (SELECT *, unnest(range(0, depth + 1)) AS above FROM whole)),
sums AS (
  SELECT key, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens FROM up GROUP BY key)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM whole w JOIN sums USING (key) LEFT JOIN node p ON w.depth > 0 AND p.key = w.key[1 : w.depth - 1]"""


ORACLES: dict[str, str] = {"op11_conversation_trie": _TRIE_SQL, "op13_ranked_search": _SEARCH_SQL, "op2_ngram_jaccard_join": _JOIN_SQL, "op1_quality_rules": _rules_sql(), "quality_rules_decide": _rules_sql(0.05, 0.1), "op6_decontamination": _HITS_SQL}
