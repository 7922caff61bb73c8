"""The same queries in SQL, for DuckDB over the same tables.

Shared subqueries are text fragments; each entry is one complete statement.
"""

from __future__ import annotations

from . import queries as q
from .functions.text import BOILERPLATE_TOKENS
from .operators import sample

# Whitespace as Python's str.split() sees it; RE2's own \s is ASCII only.
SPACE = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

LISTED = ", ".join(f"'{s}'" for s in q.LISTED_SOURCES)
SCORES = (
    "scores AS (SELECT 'src' || i AS site, CAST(10 - (3 * i) % 10 AS INTEGER) AS sentiment "
    "FROM range(20) t(i) WHERE i NOT IN (6, 13))"
)
SCORED = f"""{SCORES}, scored AS (
  SELECT d.doc_id, d.text, d.lang, d.source AS site, s.sentiment,
         CAST(s.sentiment > 5 AS INTEGER) AS polarity, sha1(d.text) AS sha1
  FROM documents d JOIN scores s ON d.source = s.site)"""
CORPORA = f"""{SCORED}, corpora AS (
  SELECT doc_id, text, site, sentiment, polarity, sha1, 'known' AS corpus
  FROM scored WHERE site NOT IN ({LISTED})
  UNION ALL
  SELECT doc_id, text, source, 1, 0, sha1(text), 'listed'
  FROM documents WHERE source IN ({LISTED}))"""
PAGES = "p AS (SELECT page_id, url, html, split_part(url, '/', 3) AS host FROM pages)"
HOSTS = f"""{PAGES}, excluded AS (SELECT DISTINCT host FROM p WHERE starts_with(host, 'm.')),
host_scores AS (SELECT DISTINCT host AS site, CAST(length(host) % 10 + 1 AS INTEGER) AS sentiment
  FROM p WHERE length(host) % 7 <> 0)"""


def pieces(text: str) -> str:
    return f"len(string_split({text}, ' '))"


def tokens(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '{SPACE}+'), lambda x: x <> '')"


def strip_control(text: str) -> str:
    return f"translate({text}, chr(13) || chr(10) || chr(9), '')"


def strip_words(text: str, words: list[str]) -> str:
    for word in words:
        quoted = "".join(c if c.isalnum() or c == " " else "\\" + c for c in word)
        text = f"regexp_replace({text}, '{SPACE}{quoted}{SPACE}', '', 'g')"
    return text


CLEANED = strip_control(strip_words("text", ["token"] * len(BOILERPLATE_TOKENS)))

# The page cut up by DuckDB's own expressions: elements first, then what follows each '<',
# then each '&'. The references are those that the test tables hold.
_page = "html"
for _open, _close in (("<!--", "-->"), ("<script[ >]", "</script *>"), ("<style[ >]", "</style *>"), ("<head[ >]", "</head *>"), ("<nav[ >]", "</nav *>")):
    _page = f"regexp_replace({_page}, '(?is){_open}.*?{_close}', ' ', 'g')"
_inside = "list_transform(string_split({page}, '<')[2:], lambda x: CASE WHEN regexp_matches(x, '^[a-zA-Z/!?]') THEN ' ' || array_to_string(string_split(x, '>')[2:], '>') ELSE '<' || x END)"
_page = f"string_split({_page}, '<')[1] || array_to_string({_inside.format(page=_page)}, '')"
_names = "MAP {'amp': '&', 'lt': '<', 'gt': '>', 'quot': '\"', 'middot': '·', 'copy': '©', 'nbsp': ' '}"
_decode = f"""CASE WHEN regexp_matches(x, '^(amp|lt|gt|quot|middot|copy|nbsp)\\b')
  THEN {_names}[regexp_extract(x, '^[a-z]+')] || regexp_replace(x, '^[a-z]+;?', '') ELSE '&' || x END"""
_page = f"string_split({_page}, '&')[1] || array_to_string(list_transform(string_split({_page}, '&')[2:], lambda x: {_decode}), '')"
PAGE_TEXT = f"trim(regexp_replace({_page}, '{SPACE}+', ' ', 'g'))"

# The article: parts after each '<' are rows, blocks and links running counts over them, and the
# best run of blocks the largest difference of two prefix sums.
_shown = "html"
for _open, _close in (("<!--", "-->"), ("<script[ >]", "</script *>"), ("<style[ >]", "</style *>"), *(
        (f"<{e}[ >]", f"</{e} *>") for e in ("head", "nav", "footer", "aside", "form", "button", "select", "noscript"))):
    _shown = f"regexp_replace({_shown}, '(?is){_open}.*?{_close}', ' ', 'g')"
_BLOCK_TAGS = """'address', 'blockquote', 'body', 'center', 'dd', 'details', 'div', 'dl', 'dt', 'fieldset', 'figcaption', 'figure',
  'h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'header', 'hr', 'html', 'li', 'main', 'article', 'section', 'ol', 'p', 'pre',
  'summary', 'table', 'tbody', 'td', 'tfoot', 'th', 'thead', 'tr', 'ul'"""
_after = "string_split(part, '&')[1] || array_to_string(list_transform(string_split(part, '&')[2:], lambda x: " + _decode + "), '')"


def words(text: str) -> str:
    return f"len(list_filter(string_split_regex({text}, '{SPACE}+'), lambda x: x <> ''))"


ARTICLES = f"""shown AS (SELECT page_id, string_split({_shown}, '<') AS cut FROM pages),
parts AS (SELECT page_id, unnest(cut) AS part, generate_subscripts(cut, 1) AS k FROM shown),
tags AS (SELECT page_id, k, CASE WHEN k > 1 AND regexp_matches(part, '^[a-zA-Z/!?]') THEN lower(regexp_extract(part, '^/?([a-zA-Z0-9]*)', 1)) END AS tag,
         part LIKE '/%' AS ends, part FROM parts),
texts AS (SELECT page_id, k, tag, ends, CASE WHEN k = 1 THEN part WHEN tag IS NULL THEN '<' || part
          ELSE ' ' || array_to_string(string_split(part, '>')[2:], '>') END AS part FROM tags),
marks AS (SELECT page_id, k, {_after} AS part, CASE WHEN tag = 'a' THEN CAST(NOT ends AS INTEGER) END AS mark,
          count(*) FILTER (WHERE tag IN ({_BLOCK_TAGS})) OVER (PARTITION BY page_id ORDER BY k) AS block FROM texts),
links AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY page_id, block ORDER BY k) AS linked FROM marks),
blocks AS (SELECT page_id, block, string_agg(part, '' ORDER BY k) AS part,
           string_agg(CASE WHEN linked = 1 THEN part ELSE ' ' END, '' ORDER BY k) AS link FROM links GROUP BY page_id, block),
owns AS (SELECT page_id, trim(regexp_replace(part, '{SPACE}+', ' ', 'g')) AS part, greatest(least({words('part')} - 3 * {words('link')}, 30), -10) AS own,
         row_number() OVER (PARTITION BY page_id ORDER BY block) AS i FROM blocks WHERE {words('part')} > 0),
vals AS (SELECT *, 2 * own + coalesce(lag(own) OVER w, 0) + coalesce(lead(own) OVER w, 0) - 48 AS v FROM owns WINDOW w AS (PARTITION BY page_id ORDER BY i)),
sums AS (SELECT *, sum(v) OVER (PARTITION BY page_id ORDER BY i) AS upto, sum(v) OVER (PARTITION BY page_id ORDER BY i) - v AS before FROM vals),
gains AS (SELECT *, upto - min(before) OVER (PARTITION BY page_id ORDER BY i) AS gain, min(before) OVER (PARTITION BY page_id ORDER BY i) AS least FROM sums),
ends AS (SELECT page_id, i AS final, least FROM gains WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY gain DESC, i) = 1),
spans AS (SELECT e.page_id, final, max(s.i) AS begins FROM ends e JOIN sums s ON s.page_id = e.page_id AND s.i <= e.final AND s.before = e.least GROUP BY ALL),
articles AS (SELECT p.page_id, p.url, split_part(p.url, '/', 3) AS host, coalesce(string_agg(o.part, ' ' ORDER BY o.i), '') AS text
  FROM pages p LEFT JOIN spans s USING (page_id) LEFT JOIN owns o ON o.page_id = p.page_id AND o.i BETWEEN s.begins AND s.final GROUP BY p.page_id, p.url)"""


def counts(table: str, where: str = "true") -> str:
    return f"""counts AS (SELECT token, count(*) AS "count"
  FROM (SELECT unnest({tokens('text')}) AS token FROM {table} WHERE {where}) GROUP BY token)"""


VOCABULARY = f"""vocab AS (
  SELECT token, CAST(row_number() OVER (ORDER BY "count" DESC, token) + 3 AS INTEGER) AS id
  FROM counts QUALIFY row_number() OVER (ORDER BY "count" DESC, token) <= {q.VOCABULARY_SIZE})"""

L = q.MAX_LEN


def joined(array: str) -> str:
    return f"array_to_string({array}, ',')"


def single_arrays(ids: str) -> str:
    return f"""{joined(f'list_resize([2] || {ids} || [3], {L}, 0)')} AS input_ids,
       {joined(f'list_resize(list_resize(CAST([] AS INTEGER[]), len({ids}) + 2, 1), {L}, 0)')} AS input_mask,
       {joined(f'list_resize(CAST([] AS INTEGER[]), {L}, 0)')} AS segment_ids"""


ENCODED = f"""{counts('documents')}, {VOCABULARY}, {SCORES},
tok AS (SELECT doc_id, source, {tokens('text')} AS toks FROM documents),
lead AS (SELECT doc_id, unnest(toks[1:{L - 2}]) AS token,
         generate_subscripts(toks[1:{L - 2}], 1) AS pos FROM tok),
found AS (SELECT doc_id, list(coalesce(id, 1) ORDER BY pos) AS ids
          FROM lead LEFT JOIN vocab USING (token) GROUP BY doc_id),
enc AS (SELECT t.doc_id, s.sentiment AS label_id, coalesce(f.ids, CAST([] AS INTEGER[])) AS ids
        FROM tok t LEFT JOIN found f USING (doc_id) LEFT JOIN scores s ON t.source = s.site)"""

M = L - 3
ENCODED_PAIRS = f"""{counts('conversations')}, {VOCABULARY},
turns AS (SELECT u.conv_id || '-' || u.turn AS pair_id, {tokens('u.text')} AS ta,
          coalesce({tokens('r.text')}, CAST([] AS VARCHAR[])) AS tb
   FROM conversations u LEFT JOIN conversations r
     ON r.role = 'assistant' AND r.conv_id = u.conv_id AND r.turn = u.turn + 1
   WHERE u.role = 'user'),
sized AS (SELECT pair_id, ta, tb,
    CASE WHEN len(tb) = 0 THEN least(len(ta), {L - 2})
         ELSE least(len(ta), greatest({M} - len(tb), {-(-M // 2)})) END AS la,
    CASE WHEN len(tb) = 0 THEN 0 ELSE least(len(tb), greatest({M} - len(ta), {M // 2})) END AS lb
  FROM turns),
cut AS (SELECT pair_id, la, lb, list_concat(ta[1:la], tb[1:lb]) AS toks FROM sized),
lead AS (SELECT pair_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM cut),
found AS (SELECT pair_id, list(coalesce(id, 1) ORDER BY pos) AS ids
          FROM lead LEFT JOIN vocab USING (token) GROUP BY pair_id),
enc AS (SELECT c.pair_id, la, lb, coalesce(ids, CAST([] AS INTEGER[])) AS ids
        FROM cut c LEFT JOIN found USING (pair_id)),
laid AS (SELECT pair_id, la, lb, CASE WHEN lb = 0 THEN [2] || ids || [3]
         ELSE [2] || ids[1:la] || [3] || ids[la + 1:la + lb] || [3] END AS seq FROM enc)"""

SUBWORDS = f"""{counts('documents')}, {VOCABULARY},
starts AS (SELECT token FROM vocab UNION
           SELECT unnest(list_transform(range(1, length(token) + 1), lambda i: substr(token, i, 1)))
           FROM counts),
pieces AS (SELECT token FROM starts UNION SELECT '##' || token FROM starts),
sub AS (SELECT token, CAST(row_number() OVER (ORDER BY token) + 3 AS INTEGER) AS id FROM pieces)"""

SEGMENTED = f"""{SUBWORDS},
tok AS (SELECT doc_id, ({tokens('text')})[1:{L - 2}] AS toks FROM documents),
lead AS (SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM tok),
words AS (SELECT DISTINCT token AS word FROM lead),
longest AS (SELECT max(length(token)) AS n FROM sub),
starting AS (SELECT word, unnest(range(1, length(word) + 1)) AS pos FROM words),
spans AS (SELECT word, pos, unnest(range(1, least(length(word) - pos + 1, n) + 1)) AS len
          FROM starting, longest),
matched AS (SELECT s.word, s.pos, max(s.len) AS len, arg_max(v.id, s.len) AS id
   FROM spans s JOIN sub v
     ON v.token = CASE WHEN s.pos = 1 THEN substr(s.word, 1, s.len)
                       ELSE '##' || substr(s.word, s.pos, s.len) END
   GROUP BY s.word, s.pos),
walk AS (SELECT word, CAST(1 AS BIGINT) AS pos, CAST([] AS INTEGER[]) AS ids FROM words
   UNION ALL
   SELECT w.word, w.pos + m.len, list_append(w.ids, m.id)
   FROM walk w JOIN matched m ON m.word = w.word AND m.pos = w.pos),
split AS (SELECT word, ids FROM walk WHERE pos = length(word) + 1),
found AS (SELECT doc_id, (flatten(list(coalesce(ids, [1]) ORDER BY pos)))[1:{L - 2}] AS ids
          FROM lead LEFT JOIN split ON lead.token = split.word GROUP BY doc_id),
enc AS (SELECT t.doc_id, coalesce(f.ids, CAST([] AS INTEGER[])) AS ids
        FROM tok t LEFT JOIN found f USING (doc_id))"""

JUDGED = """judged AS (SELECT d.doc_id, l.quality AS label, CAST(d.n_chars >= 1000 AS INTEGER) AS pred
  FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp,
             count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn,
             count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
             count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn FROM judged)"""

_logits = ", ".join(
    f"list_dot_product(CAST(embedding AS DOUBLE[]), CAST({row} AS DOUBLE[])) + {bias}"
    for row, bias in zip(q.WEIGHTS, q.BIAS, strict=True)
)
HEAD = f"""z AS (SELECT vec_id, label, [{_logits}] AS z FROM embeddings),
logged AS (SELECT vec_id, label, list_transform(z, lambda x: x - list_max(z)
           - ln(list_sum(list_transform(z, lambda y: exp(y - list_max(z)))))) AS log_probs FROM z),
head AS (SELECT vec_id, label, log_probs,
         CAST(list_position(log_probs, list_max(log_probs)) - 1 AS INTEGER) AS pred FROM logged)"""

FILES = f"""{SCORED}, files AS (
  SELECT doc_id, sha1, polarity, lang, text,
         CASE WHEN lang = 'es' THEN sha1 ELSE sha1 || '_' || sentiment END AS name,
         CASE WHEN lang <> 'es' THEN sentiment END AS sentiment FROM scored)"""

_reason = f"""CASE WHEN e.host IS NOT NULL THEN 'excluded' WHEN {pieces('p.text')} < 200 THEN 'too_short'
  WHEN s.sentiment IS NULL THEN 'unscored' ELSE 'kept' END"""

SITE_COUNTS = f"""{SCORES}, per_site AS (
  SELECT d.source AS site, count(*) AS found,
         count(*) FILTER (WHERE {pieces('d.text')} >= 50 AND s.sentiment IS NOT NULL
           AND d.source <> 'src3') AS included
  FROM documents d LEFT JOIN scores s ON d.source = s.site GROUP BY d.source)"""


def _variants() -> str:
    limits = " UNION ALL ".join(f"SELECT {n} AS token_limit" for n in (32, 128, 256))
    return f"""{CORPORA},
  n AS (SELECT corpus, sentiment, polarity, 'raw' AS spaces, len({tokens('text')}) AS n FROM corpora
        UNION ALL
        SELECT corpus, sentiment, polarity, 'stripped', len({tokens(strip_control('text'))}) FROM corpora),
  grid AS (SELECT * FROM (SELECT 'sentiment' AS label_kind UNION ALL SELECT 'polarity'),
                         (SELECT 'known' AS corpora UNION ALL SELECT 'combined'), ({limits}))
  SELECT label_kind, corpora, spaces, CAST(token_limit AS INTEGER) AS token_limit, count(*) AS rows,
         count(DISTINCT CASE label_kind WHEN 'sentiment' THEN sentiment ELSE polarity END) AS labels,
         CAST(sum(least(n, token_limit - 2)) AS BIGINT) AS tokens
  FROM n JOIN grid ON corpora = 'combined' OR corpus = 'known'
  GROUP BY label_kind, corpora, spaces, token_limit"""


def sliced(rows: str, n: int) -> str:
    """The sample of the scored documents with the slice of each row, start included, end not."""
    case = " ".join(
        f"WHEN position >= ({a} * drawn + 9999) // 10000 AND position < {b} * drawn // 10000 THEN '{name}'"
        for name, (a, b) in sample.WIDE_SLICES.items())
    return f"""drawn AS (SELECT *, row_number() OVER (ORDER BY sha1('{q.SEED}:' || doc_id), doc_id) - 1 AS position,
        least(count(*) OVER (), {n}) AS drawn FROM {rows} QUALIFY position < {n}),
      parts AS (SELECT *, CASE {case} END AS split FROM drawn)"""



# Every length as a threshold, each counted over all rows anew.
CURVE = """j AS (SELECT CAST(n_chars AS DOUBLE) AS score, quality FROM documents JOIN labels USING (doc_id)),
t AS (SELECT DISTINCT score AS threshold FROM j),
c AS (SELECT threshold, count(*) FILTER (WHERE quality = 1 AND score >= threshold) AS tp,
  count(*) FILTER (WHERE quality = 0 AND score >= threshold) AS fp, count(*) FILTER (WHERE quality = 1 AND score < threshold) AS fn,
  count(*) FILTER (WHERE quality = 0 AND score < threshold) AS tn FROM t, j GROUP BY threshold),
curve AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr FROM c)"""

# The test tables hold no controls, ideographs or Hangul; accents are dropped by DuckDB's own function.
BASIC = f"list_filter(string_split_regex(regexp_replace(strip_accents(lower(text)), '([!-/:-@\\[-`{{-~]|\\p{{P}})', ' \\1 ', 'g'), '{SPACE}+'), lambda x: x <> '')"

ORACLES: dict[str, str] = {
    "kept_articles": f"""WITH {SCORED}
        SELECT site, polarity, count(*) AS articles FROM (
          SELECT site, polarity FROM scored WHERE {pieces('text')} >= 50
          QUALIFY row_number() OVER (PARTITION BY sha1, sentiment ORDER BY doc_id) = 1)
        GROUP BY site, polarity""",
    "site_list": "SELECT 'https://' || split_part(url, '/', 3) AS site FROM pages",
    "site_union": f"""SELECT DISTINCT source AS site,
        CASE WHEN source IN ({LISTED}) THEN 'listed' ELSE 'known' END AS grp FROM documents""",
    "text_scan": f"""WITH {FILES} SELECT DISTINCT name, sha1, sentiment, polarity,
        sha1(CASE WHEN lang = 'de' THEN ''
          ELSE replace(replace(text || chr(10), chr(13) || chr(10), chr(10)), chr(13), chr(10)) END) AS text_sha1 FROM files""",
    "labelled_scan": f"""WITH {FILES} SELECT DISTINCT name, sentiment, polarity, sha1(text || chr(10)) AS sentence_sha1
        FROM files WHERE lang NOT IN ('de', 'es')""",
    "page_text": f"SELECT page_id, {PAGE_TEXT} AS text FROM pages",
    "page_article": f"WITH {ARTICLES} SELECT page_id, text FROM articles",
    "collect_known": f"""WITH {HOSTS}, {ARTICLES}
        SELECT sha1(text) AS sha1, t.host AS site, url, sentiment,
               CAST(sentiment > 5 AS INTEGER) AS polarity, 'known' AS corpus,
               CAST(length(text) AS INTEGER) AS chars
        FROM articles t JOIN host_scores s ON t.host = s.site
        WHERE t.host NOT IN (SELECT host FROM excluded) AND {pieces('text')} >= 50""",
    "collect_listed": f"""WITH {ARTICLES} SELECT sha1(text) AS sha1, url, 1 AS sentiment, 0 AS polarity, 'listed' AS corpus
        FROM articles WHERE length(text) >= 1000""",
    "collect_stored": f"""WITH {ARTICLES}, t AS (
          SELECT host AS site, url, text FROM articles
          UNION ALL SELECT host, CASE WHEN page_id % 2 = 0 THEN url END, text FROM articles WHERE page_id % 5 = 0
          UNION ALL SELECT host, 'https://one.example/for/many', text FROM articles WHERE page_id % 7 = 0)
        SELECT sha1(text) AS sha1, site, url, 1 AS sentiment, 0 AS polarity, 'listed' AS corpus
        FROM t WHERE length(text) >= 1000
        QUALIFY row_number() OVER (PARTITION BY sha1(text) ORDER BY url NULLS FIRST, site) = 1""",
    "article_sink": f"""WITH {CORPORA} SELECT doc_id, corpus, sentiment, polarity, true AS intact
        FROM corpora""",
    "clean_corpus_job": f"""WITH {CORPORA} SELECT corpus, polarity, count(*) AS "count",
        CAST(sum(length({CLEANED})) AS BIGINT) AS chars FROM corpora GROUP BY corpus, polarity""",
    "incremental_append": "SELECT page_id, url FROM pages",
    "incremental_stream": f"""WITH {PAGES} SELECT page_id, url,
        CASE WHEN starts_with(host, 'blog.') THEN 0 ELSE 1 END AS batch FROM p""",
    "tokenize": f"SELECT doc_id, array_to_string({tokens('text')}, ' ') AS tokens FROM documents",
    "host_extract": "SELECT page_id, split_part(url, '/', 3) AS host FROM pages",
    "host_exclude": f"WITH {HOSTS} SELECT page_id, host FROM p WHERE host NOT IN (SELECT host FROM excluded)",
    "seen_url_anti": f"""WITH {PAGES} SELECT page_id, url FROM p
        WHERE url NOT IN (SELECT url FROM p WHERE starts_with(host, 'blog.'))""",
    "strip_control": f"SELECT doc_id, {strip_control('text')} AS text FROM documents",
    "strip_literal_token": f"SELECT doc_id, {CLEANED} AS text FROM documents",
    "strip_listed_tokens": f"""SELECT doc_id, {strip_control(strip_words('text', list(q.RECURRING)))} AS text
        FROM documents""",
    "min_words": f"""SELECT doc_id, CAST({pieces(strip_control('text'))} AS INTEGER) AS pieces FROM documents
        WHERE {pieces(strip_control('text'))} >= 50""",
    "min_chars": "SELECT doc_id FROM documents WHERE length(text) >= 1000",
    "site_scored": f"WITH {SCORED} SELECT doc_id, site, sentiment FROM scored",
    "unscored_report": f"""WITH {SCORES} SELECT source AS site, count(*) AS articles FROM documents
        WHERE source NOT IN (SELECT site FROM scores) GROUP BY source""",
    "polarity": f"WITH {SCORED} SELECT doc_id, polarity FROM scored",
    "constant_score": f"SELECT doc_id, 1 AS sentiment, 0 AS polarity FROM documents WHERE source IN ({LISTED})",
    "content_key": "SELECT doc_id, sha1(text) AS sha1 FROM documents",
    "name_roundtrip": f"WITH {SCORED} SELECT doc_id, sha1 || '_' || sentiment AS name, sentiment FROM scored",
    "hash_split": """SELECT doc_id, CASE CAST('0x' || substr(sha1(text), 1, 8) AS BIGINT) % 101
        WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM documents""",
    "example_projection": f"""WITH {CORPORA} SELECT doc_id, text AS text_a, CAST(NULL AS VARCHAR) AS text_b,
        polarity AS label FROM corpora""",
    "label_index": f"""WITH {SCORES} SELECT doc_id,
        CAST(list_position([10, 9, 8, 7, 6, 5, 4, 3, 1], sentiment) - 1 AS INTEGER) AS label_id
        FROM documents d LEFT JOIN scores s ON d.source = s.site""",
    "label_names": f"""WITH {JUDGED} SELECT doc_id, CASE pred WHEN 0 THEN 'Negative' ELSE 'Positive' END AS label
        FROM judged""",
    "drop_reasons": f"""WITH {HOSTS}, {ARTICLES} SELECT p.host AS site, {_reason} AS reason, count(*) AS "count"
        FROM articles p LEFT JOIN excluded e ON p.host = e.host LEFT JOIN host_scores s ON p.host = s.site
        GROUP BY 1, 2""",
    "site_counts": f"WITH {SITE_COUNTS} SELECT site, found, included FROM per_site",
    "site_rollup": f"""WITH {SITE_COUNTS} SELECT site, CAST(sum(found) AS BIGINT) AS found,
        CAST(sum(included) AS BIGINT) AS included, CAST(grouping(site) AS INTEGER) AS is_total
        FROM per_site GROUP BY ROLLUP (site)""",
    "polarity_counts": f"""WITH {CORPORA} SELECT corpus, polarity, count(*) AS "count" FROM corpora
        GROUP BY corpus, polarity""",
    "corpus_counts": f'WITH {CORPORA} SELECT corpus, count(*) AS "count" FROM corpora GROUP BY corpus',
    "load_counts": f"""WITH {FILES} SELECT polarity, count(*) FILTER (WHERE lang NOT IN ('de', 'es')) AS success,
        count(*) FILTER (WHERE lang IN ('de', 'es')) AS fails,
        count(*) FILTER (WHERE lang = 'de' OR text = '') AS empty FROM files GROUP BY polarity""",
    "token_frequency": f'WITH {counts("documents")} SELECT token, "count" FROM counts',
    "token_frequency_neg": f"""WITH {CORPORA}, {counts('corpora', 'polarity = 0')}
        SELECT token, "count" FROM counts ORDER BY "count", token""",
    "shuffled": f"""SELECT doc_id, lang, sha1('{q.SEED}:' || doc_id) AS order_key FROM documents
        ORDER BY order_key, doc_id""",
    "sample_n": f"""SELECT doc_id, source AS site, text FROM documents
        ORDER BY sha1('{q.SEED}:' || doc_id), doc_id LIMIT 150""",
    "split_slices": f"""WITH drawn AS (SELECT doc_id,
          row_number() OVER (ORDER BY sha1('{q.SEED}:' || doc_id), doc_id) - 1 AS position
          FROM documents QUALIFY position < {q.SAMPLE})
        SELECT doc_id, position, CASE WHEN position < 900 THEN 'train'
          WHEN position BETWEEN 901 AND 949 THEN 'dev' ELSE 'test' END AS split
        FROM drawn WHERE position < 900 OR position BETWEEN 901 AND 949 OR position BETWEEN 951 AND 998""",
    "preview": "SELECT doc_id, source AS site, lang FROM documents ORDER BY doc_id LIMIT 5",
    "exact_dedupe": f"""WITH {SCORED} SELECT doc_id, sha1, sentiment FROM scored
        QUALIFY row_number() OVER (PARTITION BY sha1, sentiment ORDER BY doc_id) = 1""",
    "dedupe_texts": f"""WITH {SCORED} SELECT doc_id, sha1, sentiment, text FROM scored
        QUALIFY row_number() OVER (PARTITION BY sha1, sentiment ORDER BY doc_id) = 1""",
    "cleaned_dedupe": f"""WITH {SCORED}, k AS (SELECT doc_id, sha1({CLEANED}) AS sha1, sentiment FROM scored)
        SELECT doc_id, sha1, sentiment FROM k
        QUALIFY row_number() OVER (PARTITION BY sha1, sentiment ORDER BY doc_id) = 1""",
    "combined_corpus": f"""WITH {CORPORA} SELECT doc_id, corpus, sha1, sentiment, polarity FROM corpora
        WHERE corpus = 'known' OR polarity = 0
        QUALIFY row_number() OVER (PARTITION BY sha1, sentiment ORDER BY corpus, doc_id) = 1""",
    "labelled_concat": f"WITH {SCORED} SELECT doc_id, sentiment, polarity FROM scored",
    "vocabulary": f"WITH {counts('documents')}, {VOCABULARY} SELECT token, id FROM vocab",
    "encode_single": f"WITH {ENCODED} SELECT doc_id, label_id, {single_arrays('ids')} FROM enc",
    "encode_clustered": f"""WITH {CORPORA}, {counts('documents')}, {VOCABULARY},
        tok AS (SELECT doc_id, {tokens(CLEANED)} AS toks FROM corpora),
        lead AS (SELECT doc_id, unnest(toks[1:{L - 2}]) AS token, generate_subscripts(toks[1:{L - 2}], 1) AS pos FROM tok),
        found AS (SELECT doc_id, list(coalesce(id, 1) ORDER BY pos) AS ids FROM lead LEFT JOIN vocab USING (token) GROUP BY doc_id),
        enc AS (SELECT doc_id, coalesce(ids, CAST([] AS INTEGER[])) AS ids FROM tok LEFT JOIN found USING (doc_id))
        SELECT doc_id, {single_arrays('ids')} FROM enc""",
    "encode_quality": f"""WITH {ENCODED} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS bad_ids,
        CAST(0 AS BIGINT) AS bad_mask, CAST(0 AS BIGINT) AS bad_segments,
        count(*) FILTER (WHERE label_id IS NULL) AS unknown_labels FROM enc""",
    "encode_pair": f"""WITH {ENCODED_PAIRS} SELECT pair_id,
        {joined(f'list_resize(seq, {L}, 0)')} AS input_ids,
        {joined(f'list_resize(list_resize(CAST([] AS INTEGER[]), len(seq), 1), {L}, 0)')} AS input_mask,
        {joined(f'list_resize(list_resize(list_resize(CAST([] AS INTEGER[]), la + 2, 0), len(seq), 1), {L}, 0)')}
          AS segment_ids FROM laid""",
    "subword_vocabulary": f"WITH {SUBWORDS} SELECT token, id FROM sub",
    "encode_subword": f"WITH RECURSIVE {SEGMENTED} SELECT doc_id, {single_arrays('ids')} FROM enc",
    "basic_tokens": f"SELECT doc_id, array_to_string({BASIC}, ' ') AS tokens FROM documents",
    "encode_basic": f"WITH RECURSIVE {SEGMENTED.replace(tokens('text'), BASIC)} SELECT doc_id, {single_arrays('ids')} FROM enc",
    "linear_head": f"""WITH {HEAD} SELECT vec_id, pred,
        CAST(generate_subscripts(log_probs, 1) - 1 AS INTEGER) AS label_id,
        unnest(list_transform(log_probs, lambda x: round(x, 6))) AS log_prob FROM head""",
    "one_hot": f"""SELECT vec_id, CAST(i AS INTEGER) AS label_id, CAST(i = label AS DOUBLE) AS hot
        FROM embeddings, range({q.VECTOR_LABELS}) t(i)""",
    "cross_entropy": f"WITH {HEAD} SELECT vec_id, round(-log_probs[label + 1], 6) AS loss FROM head",
    "mean_loss": f"WITH {HEAD} SELECT round(avg(-log_probs[label + 1]), 6) AS loss FROM head",
    "accuracy": f"WITH {JUDGED} SELECT round(avg(CAST(label = pred AS INTEGER)), 9) AS accuracy FROM judged",
    "binary_counts": f"WITH {JUDGED} SELECT tp, tn, fp, fn FROM c",
    "prf1": f"""WITH {JUDGED} SELECT round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision,
        round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall,
        round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM c""",
    "hard_auc": f"""WITH {JUDGED} SELECT round((coalesce(tp / nullif(tp + fn, 0), 0)
        + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 9) AS auc FROM c""",
    "score_auc": """WITH per_score AS (SELECT n_chars, count(*) FILTER (WHERE quality = 1) AS pos,
          count(*) FILTER (WHERE quality = 0) AS neg
          FROM documents JOIN labels USING (doc_id) GROUP BY n_chars),
        below AS (SELECT pos, neg, sum(neg) OVER (ORDER BY n_chars) - neg AS lower FROM per_score)
        SELECT round(CAST(sum(pos * (lower + neg / 2)) / (sum(pos) * sum(neg)) AS DOUBLE), 9) AS auc FROM below""",
    "threshold_curve": f"""WITH {CURVE} SELECT threshold, tp, fp, fn, tn, round(precision, 9) AS precision,
        round(recall, 9) AS recall, round(f1, 9) AS f1, round(fpr, 9) AS fpr FROM curve""",
    "best_threshold": f"""WITH {CURVE} SELECT threshold, tp, fp, fn, tn, round(f1, 9) AS f1
        FROM curve ORDER BY curve.f1 DESC, threshold DESC LIMIT 1""",
    "confusion": f'WITH {HEAD} SELECT label, pred, count(*) AS "count" FROM head GROUP BY label, pred',
    "variant_counts": f"WITH {_variants()}",
    "train_softmax": """SELECT CAST(label AS INTEGER) AS label, count(*) AS rows, CAST(count(*) AS DOUBLE) AS expected
        FROM embeddings GROUP BY label""",
    "train_scores": f"""WITH {SCORED}, {sliced('scored', q.TRAIN_SAMPLE)}
        SELECT split, sentiment AS label, count(*) AS rows,
               CASE split WHEN 'train' THEN CAST(count(*) AS DOUBLE) END AS expected
        FROM parts WHERE split IS NOT NULL GROUP BY split, sentiment""",
}
