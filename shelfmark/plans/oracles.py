"""The same queries in ANSI SQL, to check results against another engine."""

from __future__ import annotations

import warnings

from shelfmark.functions.vocab import COUNTRIES, cloud_stop_words, stop_words
from shelfmark.functions.text import SHORT_SUMMARY
from shelfmark.operators.lookup import CATEGORY_LABELS
from shelfmark.plans import queries as q

SPLIT = r"'\s+'"
WORD = r"[\p{L}\p{N}_]"

CORPUS = """corpus AS (
  SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, source AS authors, text AS summary, lang
  FROM documents)"""


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _cloud_stop() -> str:
    return _list(cloud_stop_words())


def _runs(col: str, n: int) -> str:
    return f"regexp_extract_all(lower({col}), '{WORD}{{{n},}}')"


def _words(col: str) -> str:
    return f"list_filter(string_split_regex(lower({col}), {SPLIT}), lambda x: x <> '')"


def _grams(col: str) -> str:
    chars = f"string_split(lower({col}), '')"
    return f"list_distinct(list_transform(list_zip({chars}, {chars}[2:], true), lambda z: z[1] || z[2]))"


def _country(col: str, word: bool = False) -> str:
    whens = []
    for country, variants in COUNTRIES.items():
        if word:
            pattern = "|".join(variants)
            test = f"regexp_matches(lower({col}), '(^|[^\\p{{L}}\\p{{N}}_])({pattern})($|[^\\p{{L}}\\p{{N}}_])')"
        else:
            test = " OR ".join(f"contains(lower({col}), '{v}')" for v in variants)
        whens.append(f"WHEN {test} THEN '{country}'")
    return "CASE " + " ".join(whens) + " END"


def _tagged(word: bool = False) -> str:
    return (
        f"tagged AS (SELECT *, coalesce({_country('authors', word)}, {_country('summary', word)}) AS country FROM corpus)"
    )


def _flag() -> str:
    return " OR ".join(f"contains(lower(summary), '{w}')" for w in q.CATEGORY)


RAW = r"""raw AS (
  SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS abstract,
    CASE WHEN source <> 'src3' THEN source ELSE '' END AS contributors,
    CASE lang WHEN 'en' THEN '10.1000/' || doc_id
              WHEN 'fr' THEN 'https://doi.org/10.1000/' || doc_id ELSE '' END AS doi
  FROM documents),
cleaned AS (
  SELECT doc_id, regexp_replace(title, '^\s+|\s+$', '', 'g') AS title,
    regexp_replace(abstract, '^\s+|\s+$', '', 'g') AS summary, contributors AS authors, doi
  FROM raw),
normal AS (
  SELECT doc_id, title, authors,
    CASE WHEN length(summary) > 20 THEN summary ELSE '""" + SHORT_SUMMARY + r"""' END AS summary,
    '20260401' AS published,
    CASE WHEN doi = '' THEN '' WHEN starts_with(doi, 'http') THEN doi ELSE 'https://doi.org/' || doi END AS url
  FROM cleaned WHERE length(title) > 5)"""

def _dated() -> str:
    return """dated AS (
  SELECT o_orderkey, year(o_orderdate) AS y, o_orderpriority AS source,
    CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y%m%d')
      WHEN 'O' THEN strftime(o_orderdate, '%Y-%m-%d')
      ELSE month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) END AS published
  FROM orders)"""


PAIRS = """pair AS (
  SELECT a.doc_id AS id_a, b.doc_id AS id_b, a.text AS text_a, b.text AS text_b
  FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"""

# Letters beyond ASCII become unused control characters, one for one: the distance function
# of the other engine counts bytes.
_ACCENTS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_CODES = " || ".join(f"chr({i})" for i in [*range(1, 10), *range(11, 11 + len(_ACCENTS) - 9)])


def _bytewise(col: str) -> str:
    return f"translate({col}, '{_ACCENTS}', {_CODES})"


def _set_size(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


SCORES = f"""prepared AS (
  SELECT *, {_words('text_a')} AS wa, {_words('text_b')} AS wb, {_grams('text_a')} AS ga, {_grams('text_b')} AS gb
  FROM pair),
sets AS (SELECT *, list_distinct(wa) AS sa, list_distinct(wb) AS sb FROM prepared),
scores AS (
  SELECT id_a, id_b, text_a, text_b,
    CASE WHEN len(sa) = 0 OR len(sb) = 0 THEN 0.0
      ELSE {_set_size('sa', 'sb')}::DOUBLE / (len(sa) + len(sb) - {_set_size('sa', 'sb')}) END AS jaccard,
    CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0
      ELSE len(list_filter(list_zip(wa, wb), lambda x: x[1] = x[2]))::DOUBLE / greatest(len(wa), len(wb)) END AS hamming_words,
    CASE WHEN len(ga) = 0 OR len(gb) = 0 THEN 0.0
      ELSE 2.0 * {_set_size('ga', 'gb')} / (len(ga) + len(gb)) END AS dice
  FROM sets)"""

LEVENSHTEIN = f"""lev AS (
  SELECT id_a, id_b, CASE WHEN greatest(length(text_a), length(text_b)) = 0 THEN 1.0
    ELSE 1 - levenshtein({_bytewise('text_a')}, {_bytewise('text_b')})::DOUBLE
      / greatest(length(text_a), length(text_b)) END AS levenshtein
  FROM pair)"""

PAIR_TFIDF = f"""tok AS (
  SELECT id_a, id_b, 1 AS a, 0 AS b, unnest({_runs('text_a', 2)}) AS term FROM pair
  UNION ALL SELECT id_a, id_b, 0, 1, unnest({_runs('text_b', 2)}) FROM pair),
tf AS (SELECT id_a, id_b, term, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM tok GROUP BY ALL),
wt AS (SELECT id_a, id_b, a * i AS a, b * i AS b FROM
  (SELECT *, CASE WHEN a > 0 AND b > 0 THEN 1.0 ELSE 1 + ln(1.5) END AS i FROM tf)),
cosines AS (
  SELECT id_a, id_b, CASE WHEN count(a) = 0 THEN NULL WHEN sum(a * a) = 0 OR sum(b * b) = 0 THEN 0.0
    ELSE sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) END AS tfidf_cosine
  FROM wt RIGHT JOIN pair USING (id_a, id_b) GROUP BY id_a, id_b)"""


def _cosine(a: str, b: str) -> str:
    a, b = f"{a}::DOUBLE[]", f"{b}::DOUBLE[]"
    dot = "list_inner_product"
    return f"{dot}({a}, {b}) / (sqrt({dot}({a}, {a})) * sqrt({dot}({b}, {b})))"


EMBEDDED = """emb AS (
  SELECT a.vec_id AS id_a, b.vec_id AS id_b, a.embedding AS va, b.embedding AS vb
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def _set_join(items: str, measure: str, threshold: float) -> str:
    score = "c / (na + nb - c)" if measure == "jaccard" else "2 * c / (na + nb)"
    return f"""
WITH s AS (SELECT doc_id AS id, list_sort(list_distinct({items})) AS items FROM documents),
node AS (SELECT min(id) AS id, count(*) AS copies, items, len(items) AS n FROM s WHERE len(items) > 0 GROUP BY items),
tok AS (SELECT id, n, copies, unnest(items) AS t FROM node),
common AS (
  SELECT a.id AS id_a, b.id AS id_b, a.copies AS copies_a, b.copies AS copies_b,
    a.n AS na, b.n AS nb, count(*)::DOUBLE AS c
  FROM tok a JOIN tok b ON a.t = b.t AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b, copies_a, copies_b, round({score}, 6) AS score FROM common WHERE {score} >= {threshold}"""


def _cosine_join(threshold: float) -> str:
    return f"""
WITH s AS (SELECT doc_id AS id, list_sort({_runs('text', 2)}) AS bag FROM documents),
n AS (SELECT count(*) AS n FROM s),
node AS (SELECT min(id) AS id, count(*) AS copies, bag FROM s WHERE len(bag) > 0 GROUP BY bag),
tf AS (SELECT id, copies, term, count(*) AS tf FROM (SELECT id, copies, unnest(bag) AS term FROM node) GROUP BY ALL),
df AS (SELECT term, sum(copies) AS df FROM tf GROUP BY term),
raw AS (SELECT id, copies, term, tf * (ln((1.0 + n.n) / (1.0 + df)) + 1.0) AS w FROM tf JOIN df USING (term), n),
norm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY id),
unit AS (SELECT raw.id, copies, term, w / norm AS w FROM raw JOIN norm USING (id)),
dot AS (
  SELECT a.id AS id_a, b.id AS id_b, a.copies AS copies_a, b.copies AS copies_b, sum(a.w * b.w) AS score
  FROM unit a JOIN unit b ON a.term = b.term AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b, copies_a, copies_b, round(score, 6) AS score FROM dot WHERE score >= {threshold}"""


def _vectors() -> str:
    """Vectors in long form: ``vec`` (id, term, w)."""
    stop = _list(stop_words("english"))
    return f"""kept AS (
  SELECT doc_id AS id, list_filter({_runs('text', 2)}, lambda x: x NOT IN ({stop})) AS w FROM documents),
gram AS (
  SELECT id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
  FROM kept),
vocab AS (SELECT term FROM gram GROUP BY term ORDER BY count(*) DESC, term LIMIT 150),
tf AS (SELECT id, term, count(*) AS tf FROM gram JOIN vocab USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) AS n FROM documents),
raw AS (SELECT id, term, tf * (ln((1.0 + n.n) / (1.0 + df)) + 1.0) AS w FROM tf JOIN df USING (term), n),
norm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY id),
vec AS MATERIALIZED (SELECT id, term, w / norm AS w FROM raw JOIN norm USING (id)),
dots AS MATERIALIZED (SELECT a.id AS x, b.id AS y, sum(a.w * b.w) AS dot FROM vec a JOIN vec b USING (term) GROUP BY ALL),
docs AS (SELECT doc_id AS id, lang, source FROM documents),
length2 AS (SELECT id, coalesce(dot, 0) AS q FROM docs LEFT JOIN dots ON x = id AND y = id)"""


def _silhouette(label: str, distance: str) -> str:
    return f"""
WITH {_vectors()},
pairs AS (
  SELECT a.id AS x, b.id AS y, a.{label} AS lx, b.{label} AS ly, coalesce(dot, 0) AS dot, qa.q AS qx, qb.q AS qy
  FROM docs a CROSS JOIN docs b LEFT JOIN dots ON dots.x = a.id AND dots.y = b.id
  JOIN length2 qa ON qa.id = a.id JOIN length2 qb ON qb.id = b.id),
sums AS (
  SELECT x, lx, ly, sum(CASE WHEN x = y THEN 0 ELSE {distance} END) AS total, count(*) AS n
  FROM pairs GROUP BY x, lx, ly),
ab AS (
  SELECT x, max(CASE WHEN lx = ly THEN n END) AS n,
    max(CASE WHEN lx = ly THEN total / greatest(n - 1, 1) END) AS a,
    min(CASE WHEN lx <> ly THEN total / n END) AS b
  FROM sums GROUP BY x)
SELECT round(avg(CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS score FROM ab"""


def _ward_totals() -> str:
    return f"""
WITH {_vectors()},
mean AS (SELECT sum(s * s) AS m FROM (SELECT term, sum(w) AS s FROM vec GROUP BY term)),
total AS (SELECT count(*) AS n, sum(q) AS q FROM length2)
SELECT n - 1 AS merges, n AS documents, n - 1 AS pairs, round(q - m / n, 4) AS sum_of_squares FROM total, mean"""


def _density_silhouette(eps: float) -> str:
    """DBSCAN and the silhouette of its labels; 0 for one label, or one cluster and noise."""
    found = _dbscan(eps).replace(f"WITH {_vectors()},", "", 1)
    steps, final = found.rsplit("SELECT docs.id", 1)
    return f"""
WITH {_vectors()}, {steps.strip()},
label AS MATERIALIZED (SELECT docs.id{final}),
kinds AS (SELECT count(DISTINCT label) AS n, min(label) AS low FROM label),
pairs AS (
  SELECT a.id AS x, a.label AS lx, b.label AS ly, count(*) AS n,
    sum(CASE WHEN a.id = b.id THEN 0 ELSE 1 - coalesce(dot, 0) END) AS total
  FROM label a CROSS JOIN label b LEFT JOIN dots ON dots.x = a.id AND dots.y = b.id GROUP BY ALL),
ab AS (
  SELECT x, max(CASE WHEN lx = ly THEN n END) AS n,
    max(CASE WHEN lx = ly THEN total / greatest(n - 1, 1) END) AS a, min(CASE WHEN lx <> ly THEN total / n END) AS b
  FROM pairs GROUP BY x),
score AS (SELECT avg(CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS s FROM ab)
SELECT CASE WHEN kinds.n > 2 OR (kinds.n = 2 AND low >= 0) THEN round(s, 5) ELSE 0.0 END::DOUBLE AS score FROM score, kinds"""


def _dbscan(eps: float, rounds: int = 12) -> str:
    steps = ["l0 AS (SELECT x AS id, min(y) AS m FROM near GROUP BY x)"]
    for i in range(1, rounds):
        steps.append(
            f"l{i} AS MATERIALIZED (SELECT x AS id, min(m) AS m FROM near JOIN l{i - 1} ON id = y GROUP BY x)"
        )
    last = f"l{rounds - 1}"
    return f"""
WITH {_vectors()},
near AS MATERIALIZED (SELECT x, y FROM dots WHERE 1 - dot <= {eps} OR x = y),
{", ".join(steps)},
size AS (SELECT m, count(*) AS n, dense_rank() OVER (ORDER BY m) - 1 AS label FROM {last} GROUP BY m HAVING count(*) > 1)
SELECT docs.id, coalesce(size.label, -1)::INTEGER AS label
FROM docs LEFT JOIN {last} ON {last}.id = docs.id LEFT JOIN size ON size.m = {last}.m"""


def _cloud(with_collocations: bool) -> str:
    pairs = ""
    counts = "entry AS (SELECT term, n FROM uni)"
    if with_collocations:
        pairs = f", {_collocations()}"
        counts = """
taken AS (
  SELECT term, sum(n) AS n FROM (
    SELECT term, n FROM uni UNION ALL SELECT u1, -n FROM scored UNION ALL SELECT u2, -n FROM scored)
  GROUP BY term),
entry AS (
  SELECT term, n FROM taken WHERE n > 0 UNION ALL SELECT word1 || ' ' || word2, n FROM scored)"""
    return f"""
WITH {_unigrams()}{pairs}, {counts},
top AS (SELECT term, n FROM entry ORDER BY n DESC, term LIMIT 100)
SELECT term, n::BIGINT AS n, round(n::DOUBLE / max(n) OVER (), 6) AS weight FROM top"""


def _unigrams() -> str:
    return f"""kept AS (
  SELECT doc_id AS id, list_filter({_runs('text', 3)}, lambda x: x NOT IN ({_cloud_stop()}) AND NOT regexp_full_match(x, '[0-9]+')) AS w FROM documents),
plain AS (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM kept) GROUP BY term),
name AS (
  SELECT p.term, CASE WHEN s.term IS NOT NULL THEN s.term ELSE p.term END AS counted, p.n
  FROM plain p LEFT JOIN plain s
    ON p.term LIKE '%s' AND p.term NOT LIKE '%ss' AND s.term = left(p.term, length(p.term) - 1)),
uni AS (SELECT counted AS term, sum(n) AS n FROM name GROUP BY counted)"""


def _collocations() -> str:
    low = "greatest({0}, 1e-10)"
    like = lambda k, n, p: f"({k} * ln({low.format(p)}) + ({n} - {k}) * ln({low.format('1 - ' + p)}))"
    score = (
        f"-2 * ({like('n', 'c1', '(c2 / t)')} + {like('(c2 - n)', '(t - c1)', '(c2 / t)')}"
        f" - {like('n', 'c1', '(n / c1)')} - {like('(c2 - n)', '(t - c1)', '((c2 - n) / (t - c1))')})"
    )
    return f"""pair AS (
  SELECT unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: {{'a': w[i], 'b': w[i + 1]}})) AS p FROM kept),
bi AS (SELECT p.a AS w1, p.b AS w2, count(*) AS n FROM pair GROUP BY ALL),
bifold AS (
  SELECT b.w1, CASE WHEN s.w2 IS NOT NULL THEN s.w2 ELSE b.w2 END AS w2, b.n
  FROM bi b LEFT JOIN bi s ON s.w1 = b.w1 AND b.w2 LIKE '%s' AND b.w2 NOT LIKE '%ss'
    AND s.w2 = left(b.w2, length(b.w2) - 1)),
bigram AS (SELECT w1 AS word1, w2 AS word2, sum(n) AS n FROM bifold GROUP BY ALL),
sized AS (
  SELECT word1, word2, x.counted AS u1, y.counted AS u2, b.n::DOUBLE AS n, ux.n::DOUBLE AS c1, uy.n::DOUBLE AS c2,
    (SELECT sum(n) FROM uni)::DOUBLE AS t
  FROM bigram b JOIN name x ON x.term = word1 JOIN name y ON y.term = word2
  JOIN uni ux ON ux.term = x.counted JOIN uni uy ON uy.term = y.counted),
scored AS (
  SELECT word1, word2, u1, u2, n::BIGINT AS n, score FROM (SELECT *, {score} AS score FROM sized)
  WHERE score > 30)"""


def _pair_score(name: str) -> str:
    return f"WITH {PAIRS}, {SCORES} SELECT id_a, id_b, round({name}, 6) AS {name} FROM scores"


def oracles() -> dict[str, str]:
    """name -> SQL; names without an entry have no closed form in SQL."""
    normal = f"WITH {RAW} SELECT"
    corpus, tagged = f"WITH {CORPUS}", f"WITH {CORPUS}, {_tagged()}"
    found = f"regexp_matches({{0}}, '(?i){q.SEARCH_REGEX}')"
    hit = f"({found.format('summary')} OR {found.format('title')})"
    years = "TRY_CAST(nullif(regexp_extract(summary, '([0-9]{4})', 1), '') AS INTEGER)"
    pivot = ", ".join(
        f"count(*) FILTER (WHERE source = '{p}') AS \"{p}\"" for p in q.PRIORITIES
    )
    first_of_title = f"""{normal} title, authors, summary, published, url FROM normal
        QUALIFY row_number() OVER (PARTITION BY title ORDER BY doc_id) = 1"""
    sql = {
        "normalize_csv": f"{normal} title, authors, summary, published, url, doc_id FROM normal",
        "csv_exports": f"{normal} title, authors, summary, published, url FROM normal",
        "mixed_exports": f"""{normal} title, authors, summary, published, url, CASE WHEN lang = 'en' THEN 'utf8' ELSE 'latin' END AS kind
            FROM normal JOIN documents USING (doc_id) WHERE lang IN ('en', 'de', 'es')
            UNION ALL SELECT split_part(text, chr(10), 1), source, text || chr(10) || '@mail ' || source || ' now', '2026', '', 'entries'
            FROM documents WHERE lang = 'fr'""",
        "unify_and_store": first_of_title,
        "stream_ingest": first_of_title,
        "bibtex_exports": """SELECT split_part(text, chr(10), 1) AS title, source AS authors,
            text || chr(10) || '@mail ' || source || ' now' AS summary, '2026' AS published,
            CASE WHEN lang = 'en' THEN 'https://doi.org/10.1000/' || doc_id ELSE '' END AS url FROM documents""",
        "union_exports": f"""{corpus} SELECT title, authors, 'f-' || lang AS archivo FROM corpus
            UNION ALL SELECT title, authors, NULL FROM corpus""",
        "dedup_first": f"""{corpus} SELECT id, title, authors, summary, lang FROM (
            SELECT *, row_number() OVER (PARTITION BY summary ORDER BY id) AS r FROM corpus) WHERE r = 1""",
        "dedup_stats": f"""{corpus}, k AS (SELECT summary, count(*) AS n FROM corpus GROUP BY summary)
            SELECT sum(n)::BIGINT AS total, count(*) AS unique_rows, sum(n - 1)::BIGINT AS repeated,
              count(*) FILTER (WHERE length(summary) > 20 AND summary <> '{SHORT_SUMMARY}') AS abstracts FROM k""",
        "duplicates": f"""{corpus} SELECT id, title, kept_id FROM (
            SELECT *, min(id) OVER (PARTITION BY summary) AS kept_id FROM corpus) WHERE id <> kept_id""",
        "preview": f"{corpus} SELECT * FROM corpus ORDER BY id LIMIT 5",
        "select_visible": f"{tagged} SELECT title, authors, country FROM tagged",
        "lookup_first": f"{corpus} SELECT title, summary FROM corpus WHERE title = (SELECT title FROM corpus ORDER BY id LIMIT 1) ORDER BY id LIMIT 1",
        "lookup_many": f"""{corpus} SELECT min(id) AS id, title FROM corpus
            WHERE title IN (SELECT title FROM corpus WHERE lang = 'fr') GROUP BY title""",
        "search_regex": f"{corpus} SELECT id, title FROM corpus WHERE {hit}",
        "search_text": f"""{corpus} SELECT id, title FROM corpus
            WHERE contains(lower(summary), lower('{q.SEARCH_TEXT}')) OR contains(lower(title), lower('{q.SEARCH_TEXT}'))""",
        "search_count": f"{corpus} SELECT count(*) AS hits FROM corpus WHERE {hit}",
        "flag_category": f"{corpus} SELECT id, ({_flag()}) AS is_education FROM corpus",
        "flagged": f"{corpus} SELECT id, title, authors FROM corpus WHERE {_flag()}",
        "category_share": f"""{corpus}, f AS (SELECT ({_flag()}) AS flag FROM corpus)
            SELECT CASE WHEN flag THEN '{CATEGORY_LABELS[0]}' ELSE '{CATEGORY_LABELS[1]}' END AS category,
              count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM f), 1)::DOUBLE AS share_pct
            FROM f GROUP BY flag""",
        "top_terms": f"""SELECT term, count(*) AS n FROM (SELECT unnest({_runs('text', 6)}) AS term FROM documents)
            GROUP BY term ORDER BY n DESC, term LIMIT 10""",
        "cloud_tokens": lambda: f"""SELECT term, count(*) AS n FROM (SELECT unnest({_runs('text', 3)}) AS term FROM documents)
            WHERE term NOT IN ({_cloud_stop()}) GROUP BY term""",
        "cloud_weights": lambda: _cloud(True),
        "report_cloud": lambda: _cloud(True),
        "cloud_single_words": lambda: _cloud(False),
        "collocations": lambda: f"""WITH {_unigrams()}, {_collocations()}
            SELECT word1, word2, n, round(score, 3) AS score FROM scored""",
        "tag_country": f"{tagged} SELECT id, country FROM tagged",
        "tag_country_dictionary": f"{tagged} SELECT id, country FROM tagged",
        "tag_country_words": f"WITH {CORPUS}, {_tagged(True)} SELECT id, country FROM tagged",
        "tag_nation": f"SELECT n_name, {_country('n_name')} AS country FROM nation",
        "country_counts": f"""{tagged} SELECT country, count(*) AS n FROM tagged WHERE country IS NOT NULL
            GROUP BY country ORDER BY n DESC, country LIMIT 10""",
        "headline": f"{tagged} SELECT count(*) AS records, count(DISTINCT country) AS countries FROM tagged",
        "year_of_date": f"WITH {_dated()} SELECT o_orderkey, published, y::INTEGER AS year_plot FROM dated",
        "year_of_text": f"{corpus} SELECT id, {years} AS year_plot FROM corpus",
        "valid_years": f"""{corpus} SELECT * FROM (SELECT id, {years} AS year_plot FROM corpus)
            WHERE year_plot > 1900""",
        "timeline": f"WITH {_dated()} SELECT y::INTEGER AS year, {pivot} FROM dated GROUP BY y",
        "timeline_long": f"""WITH {_dated()} SELECT y::INTEGER AS year, source, count(*) AS n
            FROM dated GROUP BY y, source""",
        "timeline_one_source": f"""WITH {_dated()} SELECT y::INTEGER AS year, count(*) AS "Fuente Externa"
            FROM dated GROUP BY y""",
        "levenshtein_pairs": f"WITH {PAIRS}, {LEVENSHTEIN} SELECT id_a, id_b, round(levenshtein, 6) AS levenshtein FROM lev",
        "tfidf_cosine_pairs": f"WITH {PAIRS}, {PAIR_TFIDF} SELECT id_a, id_b, round(tfidf_cosine, 6) AS tfidf_cosine FROM cosines",
        "embedding_cosine_pairs": f"WITH {EMBEDDED} SELECT id_a, id_b, round({_cosine('va', 'vb')}, 5) AS cosine FROM emb",
        "semantic_mean_pairs": f"""WITH {EMBEDDED} SELECT id_a, id_b,
            round(({_cosine('va[1:32]', 'vb[1:32]')} + {_cosine('va[33:64]', 'vb[33:64]')}) / 2, 5) AS semantic_mean FROM emb""",
        "pair_report": f"""WITH {PAIRS}, {SCORES}, {LEVENSHTEIN}, {PAIR_TFIDF}, {EMBEDDED}
            SELECT s.id_a, s.id_b, s.text_a, s.text_b, round(jaccard, 6) AS jaccard, round(levenshtein, 6) AS levenshtein,
              round(hamming_words, 6) AS hamming_words, round(dice, 6) AS dice, round(tfidf_cosine, 6) AS tfidf_cosine,
              round({_cosine('va', 'vb')}, 5) AS cosine_embedding, round({_cosine('va', 'vb')}, 5) AS semantic_mean
            FROM scores s JOIN lev USING (id_a, id_b) LEFT JOIN cosines USING (id_a, id_b) LEFT JOIN emb USING (id_a, id_b)""",
        "jaccard_pairs_over": _set_join(_words("text"), "jaccard", q.JACCARD_MIN),
        "minhash_pairs_over": _set_join(_words("text"), "jaccard", q.JACCARD_MIN),
        "levenshtein_pairs_over": f"""
            WITH node AS (
              SELECT title, min(id) AS id, count(*) AS copies, length(title) AS n, {_bytewise('title')} AS b
              FROM (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title FROM documents) WHERE title <> '' GROUP BY title),
            near AS (
              SELECT x.id AS id_a, y.id AS id_b, x.copies AS copies_a, y.copies AS copies_b, greatest(x.n, y.n) AS n, levenshtein(x.b, y.b) AS d
              FROM node x JOIN node y ON x.id < y.id AND x.n >= {q.LEVENSHTEIN_MIN} * y.n AND y.n >= {q.LEVENSHTEIN_MIN} * x.n)
            SELECT id_a, id_b, copies_a, copies_b, d::INTEGER AS distance, round(1 - d / n, 6) AS score
            FROM near WHERE 1 - d / n >= {q.LEVENSHTEIN_MIN} - 1e-9""",
        "dice_pairs_over": _set_join(_grams("text"), "dice", q.DICE_MIN),
        "cosine_pairs_over": _cosine_join(q.COSINE_MIN),
        "embedding_neighbours": f"""WITH p AS (
            SELECT a.vec_id AS id, b.vec_id AS neighbour, {_cosine('a.embedding', 'b.embedding')} AS sim
            FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
            r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, neighbour)::INTEGER AS rank FROM p)
            SELECT id, neighbour, rank, round(sim, 5) AS sim FROM r WHERE rank <= {q.TOP_K}""",
        "tfidf_vectors": lambda: f"WITH {_vectors()} SELECT id, term, round(w, 6) AS w FROM vec",
        "dbscan_clusters": lambda: _dbscan(0.7),
        "silhouette_euclidean": lambda: _silhouette("lang", "sqrt(greatest(qx + qy - 2 * dot, 0))"),
        "silhouette_cosine": lambda: _silhouette("source", "1 - dot"),
        "density_silhouette": lambda: _density_silhouette(0.3),
        "ward_totals": _ward_totals,
        "ward_micro_totals": """SELECT count(*) - 1 AS merges, count(*) AS documents, count(*) - 1 AS pairs, 0 AS excess_pct
            FROM documents""",
        "kmeans_totals": "SELECT count(*) AS documents, 3::BIGINT AS clusters, 0::BIGINT AS misplaced FROM documents",
        "cluster_sizes": lambda: f"SELECT 'DBSCAN' AS method, label, count(*) AS n FROM ({_dbscan(0.7)}) GROUP BY label",
        "cluster_members": lambda: f"""SELECT id, split_part(text, chr(10), 1) AS title
            FROM ({_dbscan(0.7)}) JOIN documents ON doc_id = id WHERE label = 0""",
    }
    sql.update({f"{n}_pairs": _pair_score(n) for n in ("jaccard", "hamming_words", "dice")})
    return {name: text for name, text in ((n, _text(n, t)) for n, t in sql.items()) if text is not None}


def _text(name: str, entry) -> str | None:
    """The SQL of an entry; one that cannot be built costs its own query only."""
    try:
        return entry() if callable(entry) else entry
    except Exception as error:  # noqa: BLE001 - the other queries keep their SQL
        warnings.warn(f"no SQL for {name}: {error}", stacklevel=2)
        return None
