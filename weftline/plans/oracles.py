"""The registered queries in DuckDB's SQL, over the same tables."""

from __future__ import annotations

from weftline.functions import text as T
from weftline.plans.catalogue import COMPOSED, CONFIGS, PREFERRED, TOTAL, WEIGHTS

M = T.ALL_MARKS


def flat(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{T.WS}+', ' ', 'g'))"


def clean(c: str) -> str:
    return f"(CASE WHEN lower({flat(c)}) = 'nan' THEN '' ELSE {flat(c)} END)"


def words(c: str) -> str:
    return f"list_filter(string_split({flat(c)}, ' '), lambda x: x <> '')"


def n_words(c: str) -> str:
    return f"CAST(len({words(c)}) AS BIGINT)"


def count(c: str, chars: str) -> str:
    return f"CAST(length({c}) - length(regexp_replace({c}, '[{chars}]', '', 'g')) AS BIGINT)"


def strip(c: str) -> str:
    return f"translate({c}, '{M}', '')"


def letterish(c: str) -> str:
    return rf"regexp_replace(coalesce({c}, ''), '[^\p{{L}}\p{{M}}\p{{S}}]', '', 'g')"


def letters(c: str) -> str:
    return rf"regexp_replace(coalesce({c}, ''), '[^\p{{L}}]', '', 'g')"


def loose(c: str) -> str:
    return rf"trim(lower(regexp_replace(regexp_replace(coalesce({c}, ''), '\p{{Mn}}', '', 'g'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')))"


def order(seed: str, c: str = "row_id") -> str:
    return f"md5(concat('{seed}|', CAST({c} AS VARCHAR)))"


MN = r"\p{Mn}"
PAIRS = f"pairs AS (SELECT * FROM (SELECT row_id, config, provenance, labse, src_lang, tgt_lang, {clean('src')} AS src, {clean('tgt')} AS tgt FROM raw_pairs) WHERE src <> '' AND tgt <> '')"
POOLED = f"pooled AS (SELECT * FROM (SELECT row_id, config, split_name, {clean('s')} AS s, {clean('t')} AS t FROM pool_pairs) WHERE s <> '' AND t <> '')"
RATIO = "length(tgt) * 1.0 / greatest(length(src), 1)"

SQL: dict[str, str] = {}
SQL["q01_flatten_nonempty"] = f"WITH {PAIRS} SELECT row_id, CAST(length(src) AS BIGINT) AS n_src, CAST(length(tgt) AS BIGINT) AS n_tgt, md5(tgt) AS tgt_md5 FROM pairs"
SQL["q02_dedup_exact"] = f"WITH {PAIRS} SELECT min(row_id) AS row_id, count(*) AS copies FROM pairs GROUP BY src, tgt"
SQL["q03_length_ratio"] = f"""WITH {PAIRS} SELECT row_id, {n_words('src')} AS words, round({RATIO}, 6) AS ratio,
    {n_words('src')} BETWEEN 8 AND 30 AND {RATIO} BETWEEN 0.5 AND 1.1 AS keep FROM pairs"""
_SCRIPT = f"""SELECT *, n_letters - arabic - devanagari - latin AS other FROM (SELECT *, CAST(length(k) AS BIGINT) AS n_letters, {count('k', T.ARABIC)} AS arabic,
    {count('k', T.DEVANAGARI)} AS devanagari, {count('k', 'A-Za-z')} AS latin"""
SQL["q04_script_profile"] = f"SELECT row_id, n_letters AS letters, arabic, devanagari, latin, other FROM ({_SCRIPT} FROM (SELECT row_id, {letterish('tgt')} AS k FROM raw_pairs)))"
SQL["q05_script_reject"] = f"""SELECT CASE WHEN n_letters = 0 THEN 'no_letters' WHEN devanagari / n_letters > 0.10 THEN 'devanagari' WHEN arabic / n_letters < 0.80 THEN 'arabic' ELSE 'kept' END AS reason,
    count(*) AS n FROM ({_SCRIPT} FROM (SELECT {letterish('tgt')} AS k FROM (SELECT {clean('tgt')} AS tgt FROM raw_pairs) WHERE tgt <> ''))) GROUP BY 1"""
SQL["q06_waterfall"] = f"""WITH a AS (SELECT row_id, {clean('src')} AS src, {clean('tgt')} AS tgt FROM raw_pairs),
b AS (SELECT *, CASE WHEN src = '' OR tgt = '' THEN 1 WHEN NOT ({RATIO} BETWEEN 0.5 AND 2.0) THEN 2
    WHEN {count(letters('tgt'), T.ARABIC_BASIC)} * 1.0 / greatest(length({letters('tgt')}), 1) < 0.8 THEN 3 WHEN regexp_matches(tgt, '[{T.DEVANAGARI}]') THEN 4 END AS gone FROM a),
c AS (SELECT CASE WHEN gone IS NOT NULL THEN gone WHEN row_number() OVER (PARTITION BY gone, src, {strip('tgt')} ORDER BY row_id) > 1 THEN 5 ELSE 6 END AS gone FROM b),
s AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS i, unnest(['input', 'empty', 'ratio', 'script', 'devanagari', 'duplicate']) AS stage),
k AS (SELECT i, stage, (SELECT count(*) FROM c WHERE gone > i) AS kept FROM s)
SELECT CAST(i AS BIGINT) AS stage_no, stage, kept, coalesce(lag(kept) OVER (ORDER BY i) - kept, 0) AS dropped,
    CASE WHEN lag(kept) OVER (ORDER BY i) > 0 THEN round(100.0 * kept / lag(kept) OVER (ORDER BY i), 4) END AS pct FROM k"""
SQL["q07_counts_by_config"] = "SELECT coalesce(config, '(none)') AS config, coalesce(provenance, '(none)') AS provenance, count(*) AS n FROM raw_pairs GROUP BY 1, 2"
SQL["q08_profile_rollup"] = f"""WITH {PAIRS}, x AS (SELECT coalesce(config, '(none)') AS config, {n_words('src')} AS w, length(tgt) AS c, {count('tgt', MN)} AS m FROM pairs)
SELECT CASE WHEN grouping(config) = 1 THEN '(all)' ELSE config END AS config, count(*) AS pairs, round(sum(w) / count(*), 6) AS mean_words,
    round(sum(c) / count(*), 6) AS mean_chars, round(sum(m) * 100.0 / sum(c), 6) AS density FROM x GROUP BY GROUPING SETS ((config), ())"""
SQL["q09_describe"] = f"""WITH {POOLED}, x AS (SELECT split_name, {n_words('s')} AS w, length(t) AS c FROM pooled)
SELECT split_name, count(*) AS n, round(avg(w), 6) AS mean_words, round(avg(CASE WHEN w <= 12 THEN 1 ELSE 0 END) * 100, 6) AS pct_short, max(w) AS max_words, round(avg(c), 6) AS mean_chars FROM x GROUP BY 1"""
SQL["q10_quantiles_floor"] = """WITH x AS (SELECT labse AS v, row_number() OVER (ORDER BY labse) - 1 AS i, count(*) OVER () AS n FROM raw_pairs WHERE labse IS NOT NULL)
SELECT max(n) AS n, """ + ", ".join(f"max(CASE WHEN i = floor({q} * (n - 1)) THEN v END) AS q{round(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + ", round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median FROM x"
SQL["q11_length_hist"] = f"""WITH x AS (SELECT {n_words('line')} AS n, count(*) AS c FROM dev_lines WHERE side = 'eng_Latn' GROUP BY 1)
SELECT n, round(c * 1.0 / sum(c) OVER (), 9) AS weight FROM x WHERE n BETWEEN 1 AND 60"""
SQL["q12_dedup_stripped"] = f"WITH {POOLED} SELECT min(row_id) AS row_id, count(*) AS copies FROM pooled GROUP BY s, {strip('t')}"
SQL["q13_cross_source_dedup"] = f"""WITH x AS (SELECT 0 AS r, item_id AS row_id, {clean('line')} AS text, 'held' AS source FROM dev_lines
    UNION ALL SELECT 1, row_id, {clean('tgt')}, 'raw' FROM raw_pairs UNION ALL SELECT 2, row_id, {clean('t')}, 'pool' FROM pool_pairs)
SELECT source, row_id FROM (SELECT *, row_number() OVER (PARTITION BY {strip('text')} ORDER BY r, row_id) AS k FROM x WHERE text <> '') WHERE k = 1"""


def _orthography(table: str, text: str, by: str) -> str:
    return f"""SELECT {by}, count(*) AS lines, CAST(sum(length(x)) AS BIGINT) AS chars, CAST(sum({count('x', MN)}) AS BIGINT) AS marks, count(*) FILTER ({count('x', MN)} > 0) AS marked_lines,
    CAST(sum({count('x', '.,?!;:')}) AS BIGINT) AS latin_punct, CAST(sum({count('x', T.TARGET_PUNCT)}) AS BIGINT) AS target_punct,
    CAST(sum({count('x', chr(92) + 'x{200d}')}) AS BIGINT) AS joiners, CAST(sum({count('x', chr(92) + 'x{200c}')}) AS BIGINT) AS non_joiners,
    count(*) FILTER (contains(x, '  ')) AS double_spaces, CAST(sum({count('x', T.ARABIC_BASIC)}) AS BIGINT) AS arabic, CAST(sum({count('x', 'A-Za-z')}) AS BIGINT) AS latin,
    CAST(sum({count('x', T.DEVANAGARI)}) AS BIGINT) AS devanagari
    FROM (SELECT coalesce({by}, '(none)') AS {by}, {text} AS x FROM {table} WHERE {clean(text)} <> '') GROUP BY 1"""


_RATES = """round(marks * 100.0 / chars, 6) AS marks_per_100, round(marked_lines * 100.0 / lines, 6) AS pct_marked,
    round(target_punct * 100.0 / greatest(1, latin_punct + target_punct), 6) AS pct_target_punct, round(arabic * 100.0 / chars, 6) AS pct_arabic, round(chars * 1.0 / lines, 6) AS mean_chars"""
SQL["q14_ortho_profile"] = f"SELECT *, {_RATES} FROM ({_orthography('pool_pairs', 't', 't_lang')})"
SQL["q14_top_marks"] = rf"""WITH x AS (SELECT coalesce(t_lang, '(none)') AS t_lang, unnest(regexp_extract_all(t, '\p{{Mn}}')) AS m FROM pool_pairs),
c AS (SELECT t_lang, hex(m) AS mark, count(*) AS n FROM x GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t_lang ORDER BY n DESC, mark) AS place FROM c) WHERE place <= 6"""
SQL["q14_verdict"] = f"""WITH p AS (SELECT *, {_RATES} FROM ({_orthography('raw_pairs', 'tgt', 'config')})), r AS (SELECT marks_per_100 AS rm, pct_target_punct AS rp FROM p WHERE config = 'bpcc-seed-v1'),
v AS (SELECT config, CASE WHEN rm > 0 THEN marks_per_100 / rm ELSE 'inf'::DOUBLE END AS x, abs(rp - pct_target_punct) > 15 AS map_punctuation FROM p, r)
SELECT config, round(x, 6) AS ratio, CASE WHEN x < 0.5 THEN 'critical' WHEN x < 0.85 OR x > 1.2 THEN 'mismatch' ELSE 'aligned' END AS marks, map_punctuation FROM v"""
_SIDES = f"""rows_ AS (SELECT * FROM (SELECT row_id, 'eng_Latn' AS side, {clean('s')} AS text FROM pool_pairs WHERE split_name = 'train'
    UNION ALL SELECT row_id, 'kas_Arab', {clean('t')} FROM pool_pairs WHERE split_name = 'train') WHERE text <> '')"""


def _by_key(name: str, rows: str, key, kind: str) -> str:
    return f"""{name} AS (SELECT r.row_id, r.side, '{kind}' AS kind, 1.0 AS score, min(d.item_id) AS item_id FROM (SELECT *, {key('text')} AS k FROM {rows}) r
    JOIN (SELECT item_id, side, {key('line')} AS k FROM dev_lines) d ON r.side = d.side AND r.k = d.k AND d.k <> '' GROUP BY r.row_id, r.side)"""


def _near(name: str, rows: str, least: float) -> str:
    g = "list_distinct(list_transform(range(1, greatest(length(k) - 4, 1) + 1), lambda i: substr(k, i, 5)))"
    return f"""{name}_q AS (SELECT row_id, side, {g} AS g FROM (SELECT row_id, side, replace({loose('text')}, ' ', '') AS k FROM {rows}) WHERE k <> ''),
{name}_d AS (SELECT item_id, side, {g} AS g FROM (SELECT item_id, side, replace({loose('line')}, ' ', '') AS k FROM dev_lines) WHERE k <> ''),
{name}_s AS (SELECT q.row_id, q.side, d.item_id, count(*) AS shared, any_value(q.n) AS nq, any_value(d.n) AS nd
    FROM (SELECT row_id, side, len(g) AS n, unnest(g) AS gram FROM {name}_q) q JOIN (SELECT item_id, side, len(g) AS n, unnest(g) AS gram FROM {name}_d) d
    ON q.side = d.side AND q.gram = d.gram AND q.n >= {least} * d.n AND d.n >= {least} * q.n GROUP BY 1, 2, 3),
{name}_j AS (SELECT row_id, side, item_id, shared * 1.0 / (nq + nd - shared) AS score FROM {name}_s),
{name} AS (SELECT row_id, side, 'near' AS kind, score, item_id FROM (SELECT *, row_number() OVER (PARTITION BY row_id, side ORDER BY score DESC, item_id) AS k FROM {name}_j WHERE score >= {least} - 1e-12) WHERE k = 1)"""


_LEFT1 = "rest1 AS (SELECT * FROM rows_ r WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.row_id = r.row_id AND e.side = r.side))"
_LEFT2 = "rest2 AS (SELECT * FROM rest1 r WHERE NOT EXISTS (SELECT 1 FROM loose_ e WHERE e.row_id = r.row_id AND e.side = r.side))"
_CHEAP = f"{_SIDES}, {_by_key('exact', 'rows_', clean, 'exact')}, {_LEFT1}, {_by_key('loose_', 'rest1', loose, 'loose')}"
SQL["q15_leak_exact"] = f"WITH {_SIDES}, {_by_key('exact', 'rows_', clean, 'exact')} SELECT row_id, side, item_id FROM exact"
SQL["q16_leak_loose"] = f"WITH {_CHEAP} SELECT row_id, side, kind, item_id FROM exact UNION ALL SELECT row_id, side, kind, item_id FROM loose_"
SQL["q17_leak_jaccard"] = f"WITH {_SIDES}, {_near('near', 'rows_', 0.6)} SELECT row_id, side, round(score, 6) AS score, item_id FROM near"
SQL["q18_leak_report"] = f"""WITH {_CHEAP}, {_LEFT2}, {_near('near', 'rest2', 0.6)}, every AS (SELECT * FROM exact UNION ALL SELECT * FROM loose_ UNION ALL SELECT * FROM near)
SELECT side, kind, count(*) AS rows, count(DISTINCT item_id) AS lines FROM every GROUP BY 1, 2"""
SQL["q53_overlap_count"] = f"SELECT count(*) AS n FROM raw_pairs WHERE lower({flat('src')}) IN (SELECT lower({flat('s')}) FROM pool_pairs)"

_STRATA = f"""{POOLED}, strata AS (SELECT row_id, config, {n_words('s')} AS n FROM pooled WHERE split_name = 'train'),
hist AS (SELECT n, round(count(*) * 1.0 / sum(count(*)) OVER (), 9) AS weight FROM strata WHERE n BETWEEN 1 AND 40 GROUP BY n),
ex AS (SELECT n, round(weight * {TOTAL} / sum(weight) OVER (), 9) AS x FROM hist),
needs AS (SELECT n, CAST(floor(x) + CASE WHEN row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, n) <= {TOTAL} - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS need FROM ex)"""
_ORDER = "CASE config " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate([PREFERRED, *CONFIGS], 1)) + " END"
_FILLED = f"""{_STRATA}, known AS (SELECT *, {_ORDER} AS c, {order('0')} AS h FROM strata WHERE {_ORDER} IS NOT NULL),
ranked AS (SELECT k.*, need, row_number() OVER (PARTITION BY k.n, config ORDER BY h, row_id) AS r FROM known k JOIN needs USING (n)),
phased AS (SELECT *, CASE WHEN c = 1 AND r <= round_even(need * 0.4, 0) THEN 0 WHEN c > 1 THEN 1 ELSE 2 END AS phase FROM ranked WHERE r <= {TOTAL}),
filled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY phase, c, h, row_id) AS place FROM phased) WHERE place <= need)"""
SQL["q19_apportion"] = f"WITH {_STRATA} SELECT n, need FROM needs"
SQL["q20_stratified_fill"] = f"WITH {_FILLED} SELECT row_id, n, config, CAST(phase AS BIGINT) AS phase FROM filled"
SQL["q21_deal"] = f"WITH {_FILLED} SELECT row_id, n, CASE WHEN (row_number() OVER (PARTITION BY n ORDER BY h, row_id) - 1) % 2 = 0 THEN 'A' ELSE 'B' END AS hand FROM filled"
SQL["q22_split_hash"] = f"SELECT row_id, CAST(CASE WHEN row_number() OVER (ORDER BY {order('7')}, row_id) - 1 < floor(count(*) OVER () * 0.8) THEN 1 ELSE 2 END AS BIGINT) AS part FROM pool_pairs"
SQL["q23_heldout_antijoin"] = f"WITH {POOLED} SELECT split_name, count(*) AS n FROM (SELECT * FROM pooled QUALIFY row_number() OVER (PARTITION BY s, t ORDER BY row_id) = 1) p WHERE NOT EXISTS (SELECT 1 FROM pooled h WHERE h.split_name <> 'train' AND h.s = p.s AND h.t = p.t) GROUP BY 1"
SQL["q54_upweight_pairs"] = """WITH c AS (SELECT count(*) FILTER (split_name = 'train') AS rest, count(*) FILTER (split_name IS DISTINCT FROM 'train') AS sel FROM pool_pairs),
f AS (SELECT rest, sel, greatest(1, least(7, round_even(0.3 * rest / (0.7 * sel), 0))) AS times FROM c)
SELECT 'rest' AS k, rest AS n FROM f UNION ALL SELECT 'selected', CAST(sel * times AS BIGINT) FROM f"""

_KNN = """cosines AS (SELECT a.vec_id, q.vec_id AS query_id, round(list_inner_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS c FROM embeddings a, embeddings q WHERE a.vec_id <> q.vec_id AND q.vec_id % 100 = 0),
tops AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, query_id) AS k FROM cosines),
knn AS (SELECT vec_id, round(avg(c) FILTER (k <= 5), 6) AS score, max(CASE WHEN k = 1 THEN query_id END) AS query_id FROM tops GROUP BY 1),
chosen AS (SELECT vec_id, score, query_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM knn) WHERE k <= 3 ORDER BY score DESC, vec_id LIMIT 100)"""
SQL["q24_knn_score"] = f"WITH {_KNN} SELECT vec_id, score, query_id FROM knn"
SQL["q25_knn_capped"] = f"WITH {_KNN} SELECT vec_id, score, query_id FROM chosen"
SQL["q26_upweight"] = f"""WITH {_KNN}, f AS (SELECT greatest(1, least(7, round_even(0.6 * (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM chosen)) / (0.4 * (SELECT count(*) FROM chosen)), 0))) AS times)
SELECT vec_id, CAST(CASE WHEN vec_id IN (SELECT vec_id FROM chosen) THEN (SELECT times FROM f) ELSE 1 END AS BIGINT) AS copies FROM embeddings"""
SQL["q27_random_control"] = f"SELECT vec_id FROM embeddings ORDER BY {order('control', 'vec_id')}, vec_id LIMIT 100"


def _word_rows(name: str, texts: str) -> str:
    """texts: a select of row_id and text."""
    return f"""{name} AS (SELECT row_id, p - 1 AS pos, w[p] AS form, k[p] AS key, CASE WHEN p = 1 THEN '<s>' ELSE k[p - 1] END AS prev, CASE WHEN p = len(k) THEN '</s>' ELSE k[p + 1] END AS next
    FROM (SELECT row_id, w, list_transform(w, lambda x: {strip('x')}) AS k, unnest(range(1, len(w) + 1)) AS p FROM (SELECT row_id, {words('text')} AS w FROM ({texts}))))"""


def _majority(name: str, keys: str, least: int, same: bool = False) -> str:
    return f"""{name} AS (SELECT {keys}, form, n, total FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, first_row, first_pos) AS k, CAST(sum(n) OVER (PARTITION BY {keys}) AS BIGINT) AS total
    FROM (SELECT {keys}, form, count(*) AS n, min(row_id) AS first_row, arg_min(pos, (row_id, pos)) AS first_pos FROM lexwords GROUP BY {keys}, form)) WHERE k = 1 AND total >= {least}{" AND form <> key" if same else ""})"""


_TARGETS = _word_rows("lexwords", f"SELECT row_id, {clean('tgt')} AS text FROM raw_pairs WHERE tgt_lang = 'kas_Arab'")
_UNI = f"{_TARGETS}, {_majority('uni', 'key', 3, True)}"
_LEX = f"{_UNI}, {_majority('both_', 'prev, key, next', 2)}, {_majority('left_', 'prev, key', 2)}, {_majority('right_', 'key, next', 2)}"
_UNSEEN_TEXT = f"SELECT row_id, {clean('t')} AS text FROM pool_pairs WHERE split_name <> 'train'"
_FOUND = f"""{_LEX}, {_word_rows('unseen', _UNSEEN_TEXT)},
found AS (SELECT w.row_id, w.pos, w.form, w.key, coalesce(b.form, l.form, r.form, u.form) AS found, coalesce(b.form, l.form, r.form) IS NOT NULL AS by_context, u.form AS uni FROM unseen w
    LEFT JOIN both_ b ON b.prev = w.prev AND b.key = w.key AND b.next = w.next LEFT JOIN left_ l ON l.prev = w.prev AND l.key = w.key
    LEFT JOIN right_ r ON r.key = w.key AND r.next = w.next LEFT JOIN uni u ON u.key = w.key),
restored AS (SELECT row_id, string_agg(coalesce(found, key), ' ' ORDER BY pos) AS text FROM found GROUP BY 1)"""
SQL["q28_lexicon_unigram"] = f"WITH {_UNI} SELECT key, form, n, total FROM uni"
SQL["q29_lexicon_left"] = f"WITH {_UNI}, {_majority('left_', 'prev, key', 2)} SELECT prev, l.key, l.form, l.n, l.total FROM left_ l LEFT JOIN uni u ON u.key = l.key WHERE l.form <> coalesce(u.form, l.key)"
SQL["q30_lexicon_both"] = f"""WITH {_LEX} SELECT prev, key, next, form, n, total FROM both_ UNION ALL SELECT prev, key, '*', form, n, total FROM left_ UNION ALL SELECT '*', key, next, form, n, total FROM right_"""
SQL["q31_lexicon_apply"] = f"WITH {_FOUND} SELECT row_id, md5(text) AS text_md5 FROM restored"
SQL["q32_coverage"] = f"WITH {_FOUND} SELECT count(*) AS words, count(found) AS substituted, count(*) FILTER (by_context) AS by_context, round(100.0 * count(found) / count(*), 6) AS pct FROM found"
SQL["q33_merge"] = f"""WITH {_FOUND}, m AS (SELECT *, coalesce(found, key) AS model FROM found)
SELECT row_id, 'known' AS mode, md5(string_agg(coalesce(uni, model), ' ' ORDER BY pos)) AS text_md5 FROM m GROUP BY row_id
UNION ALL SELECT row_id, 'changed', md5(string_agg(CASE WHEN coalesce(uni, key) <> key THEN uni ELSE model END, ' ' ORDER BY pos)) FROM m GROUP BY row_id"""
SQL["q45_neighbour_context"] = f"""WITH {_TARGETS}, c AS (SELECT key, prev, next, count(*) AS c FROM lexwords GROUP BY ALL)
SELECT key, count(*) AS contexts, CAST(sum(c) AS BIGINT) AS n, CAST(sum(CASE WHEN prev = '<s>' THEN c ELSE 0 END) AS BIGINT) AS first, CAST(sum(CASE WHEN next = '</s>' THEN c ELSE 0 END) AS BIGINT) AS last FROM c GROUP BY key"""

_CAND = f"""cand AS (SELECT * FROM (SELECT CAST(floor((row_id - 1) / 8) AS BIGINT) AS pool, (row_id - 1) % 8 AS j, {clean('tgt')} AS text, {clean('src')} AS src FROM raw_pairs) WHERE text <> '')"""
SQL["q34_char_ngrams"] = f"""WITH {_CAND}, x AS (SELECT pool, j, replace(text, ' ', '') AS s, unnest([1, 2, 3, 4, 5, 6]) AS o FROM cand)
SELECT pool, j, CAST(o AS BIGINT) AS ord, CAST(greatest(length(s) - o + 1, 0) AS BIGINT) AS total, CAST(len(list_distinct(list_transform(range(1, greatest(length(s) - o + 1, 0) + 1), lambda i: substr(s, i, o)))) AS BIGINT) AS distinct_grams FROM x"""
_PUNCT = r"[!-/:-@\[-`{-~]"
def _chrf(cand: str) -> str:
    return f"""{cand}, tok AS (SELECT pool, j, replace(text, ' ', '') AS s, flatten(list_transform(string_split(text, ' '), lambda w: CASE WHEN length(w) > 1 AND regexp_matches(w, '{_PUNCT}$') THEN [left(w, length(w) - 1), right(w, 1)]
    WHEN length(w) > 1 AND regexp_matches(w, '^{_PUNCT}') THEN [left(w, 1), substr(w, 2)] ELSE [w] END)) AS w FROM cand),
grams AS ({" UNION ALL ".join(f"SELECT pool, j, {n} AS o, unnest(list_transform(range(1, length(s) - {n} + 2), lambda i: substr(s, i, {n}))) AS g FROM tok" for n in range(1, 7))}
    UNION ALL SELECT pool, j, 7, unnest(w) FROM tok UNION ALL SELECT pool, j, 8, unnest(list_transform(range(1, len(w)), lambda i: w[i] || chr(9) || w[i + 1])) FROM tok),
gc AS (SELECT pool, j, o, g, count(*) AS c FROM grams GROUP BY ALL), size AS (SELECT pool, j, o, sum(c) AS n FROM gc GROUP BY ALL),
hit AS (SELECT a.pool, a.j AS h, b.j AS r, a.o, sum(least(a.c, b.c)) AS m FROM gc a JOIN gc b ON a.pool = b.pool AND a.o = b.o AND a.g = b.g AND a.j <> b.j GROUP BY ALL),
ord AS (SELECT a.pool, a.j AS h, b.j AS r, coalesce(m, 0) / a.n AS p, coalesce(m, 0) / b.n AS q FROM size a JOIN size b ON a.pool = b.pool AND a.o = b.o AND a.j <> b.j
    LEFT JOIN hit ON hit.pool = a.pool AND hit.h = a.j AND hit.r = b.j AND hit.o = a.o),
chrf AS (SELECT pool, h, r, CASE WHEN avg(p) + avg(q) > 0 THEN 500 * avg(p) * avg(q) / (4 * avg(p) + avg(q)) ELSE 0 END AS s FROM ord GROUP BY ALL),
util AS (SELECT c.pool, c.j, c.text, coalesce(round(avg(s), 9), 0.0) AS u, count(*) OVER (PARTITION BY c.pool, c.text) AS n FROM cand c LEFT JOIN chrf ON chrf.pool = c.pool AND chrf.h = c.j GROUP BY c.pool, c.j, c.text)"""


_CHRF = _chrf(_CAND)
SQL["q35_chrf_pairs"] = f"WITH {_CHRF} SELECT pool, h, r, round(s, 6) AS chrf FROM chrf"
SQL["q36_mbr_select"] = f"WITH {_CHRF} SELECT pool, j, round(u, 6) AS utility FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY u DESC, n DESC, j) AS k FROM util) WHERE k = 1"
SQL["q58_winner_report"] = f"WITH {_CHRF}, w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY u DESC, n DESC, j) AS k FROM util) WHERE k = 1) SELECT count(*) AS pools, round(avg(CASE WHEN j = 0 THEN 1.0 ELSE 0.0 END), 6) AS agreement, round(avg(j), 6) AS mean_place FROM w"
SQL["q59_oracle_select"] = f"""WITH {_CHRF}, ref AS (SELECT pool, arg_max(j, length(text) * 100 - j) AS r FROM cand GROUP BY 1), s AS (SELECT c.pool, c.j, CASE WHEN c.j = ref.r OR c.text = t.text THEN 100.0 ELSE chrf.s END AS s
    FROM cand c JOIN ref USING (pool) JOIN cand t ON t.pool = c.pool AND t.j = ref.r LEFT JOIN chrf ON chrf.pool = c.pool AND chrf.h = c.j AND chrf.r = ref.r)
SELECT pool, j, round(s, 6) AS chrf FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY round(s, 9) DESC, j) AS k FROM s) WHERE k = 1"""
_MARKERS = ", ".join(f"'{w}'" for w in T.MARKER_WORDS)
_EDGE = T.EDGE_SIGNS.replace("'", "''")
_FEATURES = f"""{_CHRF}, {_UNI},
feat AS (SELECT c.pool, c.j, round(u.u / 100, 6) AS consensus, round(-abs({count('c.text', MN)} * 100.0 / length(c.text) - 18.0) / 18.0, 6) AS density,
    round(-abs(length(c.text) * 1.0 / greatest(length(c.src), 1) - 1.0) / 1.0, 6) AS length, round(-len(list_filter({words('c.text')}, lambda x: trim(x, '{_EDGE}') IN ({_MARKERS}))) * 1.0 / len({words('c.text')}), 6) AS marker
    FROM cand c JOIN util u USING (pool, j)),
cover AS (SELECT pool, j, round(count(uni.key) * 1.0 / count(*), 6) AS lexcov FROM (SELECT pool, j, {strip('unnest(' + words('text') + ')')} AS key FROM cand) w LEFT JOIN uni USING (key) GROUP BY 1, 2),
features AS (SELECT * FROM feat JOIN cover USING (pool, j))"""
SQL["q37_rerank_weighted"] = f"""WITH {_FEATURES}, s AS (SELECT pool, j, round({" + ".join(f"{w} * {f}" for f, w in WEIGHTS.items())}, 9) AS score FROM features)
SELECT pool, j, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY score DESC, j) AS k FROM s) WHERE k = 1"""
SQL["q38_spearman"] = f"""WITH {_FEATURES}, lng AS (SELECT pool, consensus AS y, unnest(['density', 'lexcov', 'length', 'marker']) AS feature, unnest([density, lexcov, length, marker]) AS x FROM features),
r AS (SELECT feature, pool, rank() OVER (PARTITION BY feature, pool ORDER BY x) + (count(*) OVER (PARTITION BY feature, pool, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY feature, pool ORDER BY y) + (count(*) OVER (PARTITION BY feature, pool, y) - 1) / 2.0 AS ry FROM lng),
v AS (SELECT feature, pool, count(*) * sum(rx * ry) - sum(rx) * sum(ry) AS cov, count(*) * sum(rx * rx) - sum(rx) ** 2 AS vx, count(*) * sum(ry * ry) - sum(ry) ** 2 AS vy FROM r GROUP BY ALL)
SELECT feature, round(avg(CASE WHEN vx > 0 AND vy > 0 THEN round(cov / sqrt(vx * vy), 9) ELSE 0 END), 4) AS rho FROM v GROUP BY 1"""


def _label(c: str) -> str:
    return f"(CASE WHEN length({c}) < 2 OR regexp_matches(left({c}, 1), '{T.WS}') THEN 0 ELSE strpos('{M}', right({c}, 1)) END)"


def _prf(pairs: str, side: str) -> str:
    units = lambda c: f"regexp_extract_all({c}, '(?s)[^{M}][{M}]?')"
    names = "".join(f" WHEN {i} THEN '{n}'" for i, n in enumerate(T.MARK_NAMES, 1))
    p, r = "CASE WHEN pred > 0 THEN hit * 100.0 / pred ELSE 0.0 END", "CASE WHEN gold > 0 THEN hit * 100.0 / gold ELSE 0.0 END"
    return f"""z AS (SELECT {side} AS side, {_label('x')} AS g, {_label('y')} AS p FROM (SELECT *, unnest({units('gold')}) AS x, unnest({units('pred')}) AS y FROM ({pairs}) WHERE {strip('gold')} = {strip('pred')})),
c AS (SELECT side, m, count(*) FILTER (g = m) AS gold, count(*) FILTER (p = m) AS pred, count(*) FILTER (g = m AND p = m) AS hit FROM z, (SELECT unnest([1, 2, 3]) AS m) WHERE g = m OR p = m GROUP BY 1, 2),
n AS (SELECT side, CASE m{names} END AS mark, gold, pred, hit FROM c UNION ALL SELECT side, 'MICRO', CAST(sum(gold) AS BIGINT), CAST(sum(pred) AS BIGINT), CAST(sum(hit) AS BIGINT) FROM c GROUP BY 1),
s AS (SELECT *, {p} AS p, {r} AS r FROM n)
SELECT side, mark, gold, pred, hit, round_even(round(p, 9), 2) AS p, round_even(round(r, 9), 2) AS r, round_even(round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 9), 2) AS f1 FROM s"""


SQL["q39_mark_prf"] = f"WITH {_FOUND}, q AS (SELECT u.text AS gold, r.text AS pred FROM ({_UNSEEN_TEXT}) u JOIN restored r USING (row_id)), {_prf('SELECT * FROM q', chr(39) + 'all' + chr(39))}".replace("SELECT side, mark, gold, pred, hit, round_even", "SELECT mark, gold, pred, hit, round_even")
SQL["q39_mark_prf_known"] = f"WITH {_FOUND}, {_prf('SELECT form AS gold, coalesce(found, key) AS pred, found FROM found', 'CASE WHEN found IS NOT NULL THEN ' + chr(39) + 'known' + chr(39) + ' ELSE ' + chr(39) + 'tail' + chr(39) + ' END')}"
SQL["q55_restoration_strategies"] = f"""WITH {_FOUND}, base AS (SELECT * FROM ({_UNSEEN_TEXT}) WHERE text <> ''),
plain AS (SELECT row_id, string_agg(coalesce(uni, key), ' ' ORDER BY pos) AS text FROM found GROUP BY 1),
every AS (SELECT 'none' AS strategy, row_id, {strip('text')} AS pred FROM base UNION ALL SELECT 'unigram', row_id, text FROM plain UNION ALL SELECT 'context', row_id, text FROM restored UNION ALL SELECT 'ceiling', row_id, text FROM base)
SELECT strategy, count(*) AS lines, round(sum({count('pred', M)}) * 100.0 / sum(length(pred)), 6) AS density, count(*) FILTER (pred = text) AS exact FROM base JOIN every USING (row_id) GROUP BY 1"""

SQL["q41_align_corr"] = f"""WITH {PAIRS}, b AS (SELECT (row_id - 1) // 50 AS block, count(*) AS n, sum(length(src)) AS x, sum(length(tgt)) AS y, sum(length(src) * length(tgt)) AS xy, sum(length(src) ** 2) AS xx, sum(length(tgt) ** 2) AS yy FROM pairs GROUP BY 1),
r AS (SELECT block, n, round(CASE WHEN n * xx - x * x > 0 AND n * yy - y * y > 0 THEN (n * xy - x * y) / sqrt((n * xx - x * x)::DOUBLE * (n * yy - y * y)::DOUBLE) ELSE 0.0 END, 6) AS r FROM b)
SELECT CAST(block AS BIGINT) AS block, n, r, n < 50 OR r >= 0.5 AS keep FROM r"""
SQL["q57_vocabulary"] = f"SELECT char, count(*) AS n FROM (SELECT unnest(regexp_extract_all({strip('tgt')}, '(?s).')) AS char FROM raw_pairs WHERE tgt IS NOT NULL) GROUP BY 1 HAVING count(*) >= 50"
SQL["q60_mean_ratio"] = f"WITH {PAIRS} SELECT round(avg({RATIO}), 6) AS mean_ratio FROM pairs"
_COS = """b AS (SELECT vec_id + CAST(floor(vec_id / 50) AS BIGINT) % 3 - 1 AS vec_id, embedding FROM embeddings),
cosx AS (SELECT a.vec_id, s, max(round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)) AS c FROM embeddings a, (SELECT unnest([-1, 0, 1]) AS s), b WHERE b.vec_id = a.vec_id + s GROUP BY 1, 2),
cos3 AS (SELECT e.vec_id, """ + ", ".join(f"coalesce(max(CASE WHEN s = {s} THEN c END), -1.0) AS cos_{i}" for i, s in enumerate((-1, 0, 1))) + " FROM embeddings e LEFT JOIN cosx USING (vec_id) GROUP BY 1)"
SQL["q42_shift_cos"] = f"WITH {_COS} SELECT vec_id, cos_0, cos_1, cos_2 FROM cos3"
SQL["q43_rolling_majority"] = f"""WITH {_COS}, o AS (SELECT *, greatest(cos_0, cos_1, cos_2) AS best FROM cos3), p AS (SELECT *, CASE WHEN cos_0 = best THEN -1 WHEN cos_1 = best THEN 0 ELSE 1 END AS offset_ FROM o),
w AS (SELECT *, {", ".join(f"count(*) FILTER (offset_ = {s}) OVER (ORDER BY vec_id ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS n{i}" for i, s in enumerate((-1, 0, 1)))} FROM p),
g AS (SELECT *, CASE WHEN n0 >= n1 AND n0 >= n2 THEN -1 WHEN n1 >= n2 THEN 0 ELSE 1 END AS regime FROM w), h AS (SELECT *, CASE regime WHEN -1 THEN cos_0 WHEN 0 THEN cos_1 ELSE cos_2 END AS chosen FROM g)
SELECT vec_id, CAST(offset_ AS BIGINT) AS "offset", CAST(regime AS BIGINT) AS regime, chosen, chosen >= 0.15 AND round(best - chosen, 9) <= 0.05 AS keep FROM h"""
_CHECKS = [
    ("columns", "error", "0", "true"), ("not_nfc", "warning", "not_nfc", "not_nfc = 0"),
    ("row_count", "error", "abs(rows_ - n_source)", "rows_ = n_source"), ("missing_ids", "error", "missing", "missing = 0"), ("extra_ids", "error", "extra", "extra = 0"),
    ("order", "error", "moved", "moved = 0"), ("empty", "error", "empty", "empty = 0"), ("nan_like", "error", "nan_like", "nan_like = 0"), ("devanagari", "error", "devanagari", "devanagari = 0"),
    ("arabic_share", "error", "arabic", "arabic * 1.0 / chars >= 0.5"), ("latin_share", "warning", "latin", "latin * 1.0 / chars <= 0.02"), ("density", "warning", "marks", "marks * 1.0 / chars * 100 >= 1.0"),
    ("duplicates", "warning", "rows_ - texts", "rows_ - texts <= rows_ * 0.05"),
]
SQL["q44_validator"] = f"""WITH src AS (SELECT row_id, row_id AS pos FROM pool_pairs),
giv AS (SELECT CASE WHEN row_id % 997 = 0 THEN -row_id ELSE row_id END AS row_id, CASE WHEN row_id % 10 = 3 THEN row_id + 1 ELSE row_id END AS pos, coalesce(t, '') AS x FROM pool_pairs),
d AS (SELECT count(*) FILTER (g.row_id IS NULL) AS missing, count(*) FILTER (s.row_id IS NULL) AS extra, count(*) FILTER (s.pos <> g.pos) AS moved FROM src s FULL JOIN giv g ON s.row_id = g.row_id),
a AS (SELECT count(*) AS rows_, count(DISTINCT x) AS texts, count(*) FILTER ({clean('x')} = '') AS empty, count(*) FILTER (lower({flat('x')}) IN ('', 'nan', 'none', 'null')) AS nan_like, sum(length(x)) AS chars,
    sum({count('x', T.DEVANAGARI)}) AS devanagari, sum({count('x', T.ARABIC_BASIC)}) AS arabic, sum({count('x', 'A-Za-z')}) AS latin, sum({count('x', MN)}) AS marks, count(*) FILTER (nfc_normalize(x) <> x) AS not_nfc FROM giv),
e AS (SELECT * FROM a, d, (SELECT count(*) AS n_source FROM src))
{" UNION ALL ".join(f'SELECT {chr(39)}{k}{chr(39)} AS "check", {chr(39)}{s}{chr(39)} AS severity, CAST({n} AS BIGINT) AS n, {p} AS pass FROM e' for k, s, n, p in _CHECKS)}"""
SQL["q46_loose_key"] = f"SELECT row_id, md5({loose('tgt')}) AS key_md5 FROM raw_pairs"
SQL["q47_encode_decode"] = f"""SELECT row_id, CAST(length({strip('tgt')}) AS BIGINT) AS n, CAST(len(regexp_extract_all(tgt, '[^{M}{T.WS[1:-1]}][{M}]')) AS BIGINT) AS marked, true AS insertion_only FROM raw_pairs WHERE tgt IS NOT NULL"""
SQL["q48_chunk"] = "SELECT doc_id, true AS within, true AS same FROM documents WHERE text IS NOT NULL"
_SOFT = lambda bias: f"list_transform(list_transform([1, 2, 3, 4], lambda i: exp(x[i] + CASE WHEN i = 1 THEN {bias} ELSE 0 END)), lambda v: v)"
_NORM = lambda c: f"list_transform({c}, lambda v: v / list_sum({c}))"
_ARG = lambda c: f"CAST(list_position({c}, list_max({c})) - 1 AS BIGINT)"
SQL["q49_decide_rules"] = f"""WITH a AS (SELECT vec_id, list_transform(embedding[1:4], lambda v: v::DOUBLE * 8) AS x FROM embeddings), b AS (SELECT vec_id, {_SOFT('0.0')} AS e, {_SOFT('-1.5')} AS f FROM a),
c AS (SELECT vec_id, {_NORM('e')} AS p, {_NORM('f')} AS q FROM b), d AS (SELECT *, p[2:4] AS m, [p[2] / 0.3, p[3] / 0.5, p[4] / 0.7] AS r FROM c)
SELECT vec_id, {_ARG('p')} AS likeliest, {_ARG('q')} AS biased, CASE WHEN 1 - p[1] >= 0.9 THEN {_ARG('m')} + 1 ELSE 0 END AS threshold, CASE WHEN list_max(r) >= 1.0 THEN {_ARG('r')} + 1 ELSE 0 END AS per_mark, round(p[1], 6) AS none FROM d"""
SQL["q50_arabic_shares"] = f"""SELECT row_id, round({count('l', T.ARABIC_BASIC)} * 1.0 / greatest(length(l), 1), 6) AS basic, round({count('l', T.ARABIC_WIDE)} * 1.0 / greatest(length(l), 1), 6) AS wide,
    round({count('x', T.ARABIC_BASIC)} * 1.0 / greatest(length(x), 1), 6) AS "all", regexp_matches(x, '[{T.DEVANAGARI}]') AS devanagari FROM (SELECT row_id, coalesce(tgt, '') AS x, {letters('tgt')} AS l FROM raw_pairs)"""
SQL["q51_score_filter"] = "SELECT provenance, count(*) AS n, count(labse) AS scored FROM raw_pairs WHERE provenance IN ('human', 'mined') AND src_lang = 'eng_Latn' AND tgt_lang = 'kas_Arab' AND (labse IS NULL OR labse >= 0.8) GROUP BY 1"
SQL["q52_text_reasons"] = f"""SELECT CASE WHEN length(text) < 80 THEN 'short' WHEN {count(letters('text'), T.ARABIC_WIDE)} * 1.0 / greatest(length({letters('text')}), 1) < 0.8 THEN 'script'
    WHEN {count('text', M)} < 5 THEN 'marks' ELSE 'kept' END AS reason, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1"""
SQL["q56_twin_files"] = """WITH n AS (SELECT file_id, count(*) FILTER (side = 'eng_Latn') AS s_lines, count(*) FILTER (side = 'kas_Arab') AS t_lines FROM twin_lines GROUP BY 1),
p AS (SELECT file_id, count(*) AS paired FROM (SELECT file_id, line_no FROM twin_lines WHERE side = 'eng_Latn') JOIN (SELECT file_id, line_no FROM twin_lines WHERE side = 'kas_Arab') USING (file_id, line_no) GROUP BY 1)
SELECT file_id, s_lines, t_lines, coalesce(paired, 0) AS paired, s_lines = t_lines AS "equal" FROM n LEFT JOIN p USING (file_id)"""

SQL["q61_jsonl"] = "SELECT coalesce(config, '(none)') AS config, count(*) AS n, count(src) AS n_src, count(tgt) AS n_tgt, CAST(coalesce(sum(length(src)), 0) AS BIGINT) AS chars_src, CAST(coalesce(sum(length(tgt)), 0) AS BIGINT) AS chars_tgt FROM raw_pairs GROUP BY 1"
SQL["q62_tsv"] = f"WITH {PAIRS} SELECT src_lang, tgt_lang, count(*) AS n, CAST(sum(length(src)) AS BIGINT) AS chars_src, CAST(sum(length(tgt)) AS BIGINT) AS chars_tgt FROM pairs WHERE src_lang IS NOT NULL AND tgt_lang IS NOT NULL GROUP BY 1, 2"
SQL["q63_twin_zip"] = f"WITH {POOLED} SELECT row_number() OVER (ORDER BY row_id) AS row_id, md5(s) AS s_md5, md5(t) AS t_md5 FROM pooled"
SQL["q64_submission_csv"] = f"SELECT CAST(row_id AS VARCHAR) AS \"ID\", md5({flat('t')}) AS text_md5 FROM pool_pairs"
SQL["q65_lexicon_json"] = f"""WITH {_LEX} SELECT '*' AS prev, key, '*' AS next, form FROM uni UNION ALL SELECT prev, key, next, form FROM both_
UNION ALL SELECT prev, key, '*', form FROM left_ UNION ALL SELECT '*', key, next, form FROM right_"""
SQL["q66_pool_files"] = f"""WITH {_CAND} SELECT pool, CAST(2 * count(*) AS BIGINT) AS n, md5(arg_min(src, j)) AS src_md5,
    md5(string_agg(text, '|' ORDER BY j) || '|' || string_agg(text, '|' ORDER BY j)) AS candidates_md5 FROM cand GROUP BY 1"""
SQL["q67_score_cache"] = "SELECT row_id, round(length(t) * 1.0 / greatest(length(s), 1), 6) AS score FROM pool_pairs WHERE s IS NOT NULL AND t IS NOT NULL"
SQL["q68_same_files"] = "SELECT sha256('lines ' || n || chr(10)) AS sha256, count(*) AS files, CAST(1 AS BIGINT) AS firsts FROM (SELECT line_no, count(line) AS n FROM twin_lines WHERE side = 'kas_Arab' GROUP BY 1) GROUP BY n"
SQL["q69_cross_corpus"] = f"""SELECT coalesce(config, '(none)') AS config, count(*) AS n FROM pool_pairs p WHERE split_name = 'train'
    AND NOT EXISTS (SELECT 1 FROM pool_pairs h WHERE h.split_name <> 'train' AND h.s = p.s AND {strip('h.t')} = {strip('p.t')}) GROUP BY 1"""
SQL["q70_leak_gate"] = f"WITH {_CHEAP}, {_LEFT2}, {_near('near_', 'rest2', 0.6)} SELECT count(*) AS n FROM (SELECT row_id FROM exact UNION SELECT row_id FROM loose_ UNION SELECT row_id FROM near_)"
SQL["q71_score_scope"] = """SELECT coalesce(provenance, '(none)') AS provenance, count(*) AS n, count(*) FILTER (labse IS NULL OR labse >= 0.8) AS passed_all,
    count(*) FILTER (labse IS NULL OR labse >= 0.8 OR provenance IS DISTINCT FROM 'mined') AS passed_mined FROM raw_pairs GROUP BY 1"""
SQL["q72_normalize"] = f"""SELECT row_id, md5(regexp_replace(regexp_replace(translate(replace(nfc_normalize(CASE WHEN tgt IS NULL OR lower(tgt) = 'nan' THEN '' ELSE tgt END), chr(8205), ''), '{T.PUNCT_FROM}', '{T.PUNCT_TO}'),
    '[ \t]{{2,}}', ' ', 'g'), '^{T.WS}+|{T.WS}+$', '', 'g')) AS text_md5 FROM raw_pairs"""
_OF = lambda s: f"CAST(sum((length(t) - length(replace(t, '{s}', ''))) // {len(s)}) AS BIGINT)"
SQL["q73_compositions"] = " UNION ALL ".join(
    f"SELECT coalesce(t_lang, '(none)') AS t_lang, '{ord(a):04x}' AS letter, {_OF(a)} AS composed, {_OF(b)} AS sequence FROM pool_pairs WHERE {clean('t')} <> '' GROUP BY 1" for a, b in COMPOSED
)
_BY_KEY = f"cand AS (SELECT pool, j, CASE WHEN {flat(strip('text'))} = '' THEN text ELSE {strip('text')} END AS text, src FROM (WITH {_CAND} SELECT * FROM cand))"
SQL["q74_mbr_by_key"] = f"WITH {_chrf(_BY_KEY)} SELECT pool, j, round(u, 6) AS utility FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY u DESC, n DESC, j) AS k FROM util) WHERE k = 1"
SQL["q75_shuffle"] = f"SELECT row_id, row_number() OVER (ORDER BY {order('shuffle')}, row_id) - 1 AS place FROM pool_pairs"
SQL["q76_line_accuracy"] = f"WITH {_FOUND} SELECT round(avg(CASE WHEN u.text = r.text THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ({_UNSEEN_TEXT}) u JOIN restored r USING (row_id)"
SQL["q77_share_alike"] = """SELECT coalesce(config, 'none') IN ('daily', 'nllb-seed') OR string_split(coalesce(source_file, 'none'), ':')[1] IN ('daily', 'nllb-seed') AS share_alike, count(*) AS n FROM raw_pairs GROUP BY 1"""
SQL["q78_left_out"] = f"""WITH {_FOUND} SELECT CASE WHEN found IS NOT NULL THEN 'known' ELSE 'tail' END AS side, count(*) AS pairs,
    count(*) FILTER ({strip('form')} IS DISTINCT FROM {strip('coalesce(found, key)')}) AS left_out FROM found GROUP BY 1"""
SQL["q79_top_scores"] = "SELECT row_id, labse FROM raw_pairs WHERE labse IS NOT NULL ORDER BY labse DESC, row_id LIMIT 50"
SQL["q80_winner_places"] = f"WITH {_CHRF} SELECT j, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY u DESC, n DESC, j) AS k FROM util) WHERE k = 1 GROUP BY 1"


def _corpus(pairs: str) -> str:
    """Corpus BLEU (13a) and chrF++ of a select of h and r."""
    signs = r"([{{-~\[-` -&(-+:-@/])".replace("{{", "{")
    cut = lambda c: f"regexp_replace({c}, '{signs}', ' \\1 ', 'g')"
    for a, b in (("([^0-9])([.,])", r"\1 \2 "), ("([.,])([^0-9])", r" \1 \2"), ("([0-9])(-)", r"\1 \2 ")):
        cut = lambda c, cut=cut, a=a, b=b: f"regexp_replace({cut(c)}, '{a}', '{b}', 'g')"
    plain = "replace(replace(replace(replace(replace(replace(replace(x, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '), '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
    tok = lambda c: f"list_filter(string_split({c}, ' '), lambda w: w <> '')"
    word = f"""flatten(list_transform({tok('x')}, lambda w: CASE WHEN length(w) > 1 AND regexp_matches(w, '{_PUNCT}$') THEN [left(w, length(w) - 1), right(w, 1)]
    WHEN length(w) > 1 AND regexp_matches(w, '^{_PUNCT}') THEN [left(w, 1), substr(w, 2)] ELSE [w] END))"""
    run = lambda c, n: f"unnest(list_transform(range(1, len({c}) - {n} + 2), lambda i: array_to_string({c}[i:i + {n} - 1], chr(9))))"
    parts = [f"SELECT i, side, {n} AS o, unnest(list_transform(range(1, length(s) - {n} + 2), lambda i: substr(s, i, {n}))) AS g FROM lines" for n in range(1, 7)]
    parts += [f"SELECT i, side, {6 + n}, {run('w', n)} FROM lines" for n in (1, 2)] + [f"SELECT i, side, {10 + n}, {run('b', n)} FROM lines" for n in range(1, 5)]
    return f"""hr AS (SELECT row_number() OVER () AS i, h, r FROM ({pairs})), sides AS (SELECT i, 'h' AS side, h AS x FROM hr UNION ALL SELECT i, 'r', r FROM hr),
lines AS (SELECT i, side, replace(x, ' ', '') AS s, {word} AS w, {tok(cut("' ' || " + plain + " || ' '"))} AS b FROM sides),
grams AS ({" UNION ALL ".join(parts)}), gc AS (SELECT i, side, o, g, count(*) AS c FROM grams GROUP BY ALL),
tot AS (SELECT o, coalesce(sum(c) FILTER (side = 'h'), 0) AS nh, coalesce(sum(c) FILTER (side = 'r'), 0) AS nr FROM gc GROUP BY 1),
hit AS (SELECT a.o, sum(least(a.c, b.c)) AS m FROM gc a JOIN gc b ON a.i = b.i AND a.o = b.o AND a.g = b.g AND a.side = 'h' AND b.side = 'r' GROUP BY 1),
st AS (SELECT o, nh, nr, coalesce(m, 0) AS m FROM (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 13, 14]) AS o) LEFT JOIN tot USING (o) LEFT JOIN hit USING (o)),
c AS (SELECT coalesce(avg(m / nh), 0) AS p, coalesce(avg(m / nr), 0) AS q FROM st WHERE o <= 8 AND nh > 0 AND nr > 0),
k AS (SELECT *, CAST(sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) OVER (ORDER BY o) AS INT) AS z FROM st WHERE o > 10),
l AS (SELECT sum(len(b)) FILTER (side = 'h') AS h, sum(len(b)) FILTER (side = 'r') AS r FROM lines),
bl AS (SELECT CASE WHEN min(coalesce(nh, 0)) = 0 OR min(CASE WHEN o = 11 THEN m END) = 0 THEN 0.0
    ELSE 100 * exp(avg(ln(CASE WHEN m = 0 THEN 1.0 / (power(2, z) * nh) ELSE m * 1.0 / nh END))) * (SELECT CASE WHEN h < r THEN exp(1 - r * 1.0 / h) ELSE 1.0 END FROM l) END AS bleu FROM k),
two AS (SELECT bleu, CASE WHEN p + q > 0 THEN 500 * p * q / (4 * p + q) ELSE 0.0 END AS chrf FROM bl, c)
SELECT (SELECT count(*) FROM hr) AS lines, round(bleu, 6) AS bleu, round(chrf, 6) AS chrf, round(sqrt(bleu * chrf), 6) AS geo, (SELECT round(avg(length(h)), 6) FROM hr) AS mean_chars,
    (SELECT round(sum(length(h)) * 1.0 / sum(length(r)), 6) FROM hr) AS ratio FROM two"""


SQL["q40_corpus_scores"] = f"WITH {_FOUND}, {_corpus(f'SELECT res.text AS h, u.text AS r FROM ({_UNSEEN_TEXT}) u JOIN restored res USING (row_id)')}"
SQL["q82_any_text"] = f"""WITH {PAIRS}, {POOLED} SELECT 'pairs' AS source, coalesce('pairs:' || config, '(none)') AS tag, count(*) AS n, CAST(sum(length(tgt)) AS BIGINT) AS chars FROM pairs GROUP BY 1, 2
UNION ALL SELECT 'lines', 'lines', count(*), CAST(sum(length(t)) AS BIGINT) FROM pooled"""
SQL["q83_settings"] = " UNION ALL ".join(f"SELECT 'w_{k}' AS name, CAST({v} AS DOUBLE) AS value" for k, v in WEIGHTS.items())
SQL["q84_vector_cache"] = "SELECT row_id, length(s) AS v1, length(replace(s, ' ', '')) AS v2 FROM pool_pairs WHERE s IS NOT NULL"
SQL["q85_shared_keys"] = f"WITH {POOLED} SELECT count(*) AS n FROM (SELECT s, t FROM pooled WHERE split_name = 'train' INTERSECT SELECT s, t FROM pooled WHERE split_name <> 'train')"
_SUMS = lambda p: f"SELECT sum({count(p, M)}) AS m, sum(length({strip(p)})) AS b, sum(length({p})) AS c"
SQL["q86_gates"] = f"""WITH {_FOUND}, u AS (SELECT {strip('text')} AS text FROM ({_UNSEEN_TEXT}) WHERE text <> ''), x AS ({_SUMS('text')} FROM u), y AS ({_SUMS('text')} FROM restored),
d AS (SELECT round(x.m * 100.0 / greatest(x.c, 1), 6) AS a, round(y.m * 100.0 / greatest(y.c, 1), 6) AS b, CAST(x.b AS DOUBLE) AS e, CAST(y.b AS DOUBLE) AS f FROM x, y)
SELECT 'density' AS gate, a AS before, b AS after, b > a AS pass FROM d UNION ALL SELECT 'base_length', e, f, abs(f - e) * 100.0 / greatest(e, 1) <= 2 FROM d"""


def _tagged(bias: float) -> str:
    """Marks by code points, as _prf counts them; the bias is put on no mark."""
    label = f"(CASE WHEN regexp_matches(left(x, 1), '{T.WS}') OR 1.0 <= {bias} THEN 0 ELSE unicode(left(x, 1)) % 4 END)"
    p, r = "CASE WHEN pred > 0 THEN hit * 100.0 / pred ELSE 0.0 END", "CASE WHEN gold > 0 THEN hit * 100.0 / gold ELSE 0.0 END"
    names = "".join(f" WHEN {i} THEN '{n}'" for i, n in enumerate(T.MARK_NAMES, 1))
    return f"""SELECT {bias} AS bias, mark, gold, pred, hit, round_even(round(p, 9), 2) AS p, round_even(round(r, 9), 2) AS r, round_even(round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 9), 2) AS f1 FROM (
WITH z AS (SELECT {_label('x')} AS g, {label} AS p FROM (SELECT unnest(regexp_extract_all(text, '(?s)[^{M}][{M}]?')) AS x FROM ({_UNSEEN_TEXT}) WHERE text <> '')),
c AS (SELECT m, count(*) FILTER (g = m) AS gold, count(*) FILTER (p = m) AS pred, count(*) FILTER (g = m AND p = m) AS hit FROM z, (SELECT unnest([1, 2, 3]) AS m) WHERE g = m OR p = m GROUP BY 1),
n AS (SELECT CASE m{names} END AS mark, gold, pred, hit FROM c UNION ALL SELECT 'MICRO', CAST(sum(gold) AS BIGINT), CAST(sum(pred) AS BIGINT), CAST(sum(hit) AS BIGINT) FROM c)
SELECT *, {p} AS p, {r} AS r FROM n)"""


SQL["q87_tagger"] = f"{_tagged(0.0)} UNION ALL {_tagged(2.0)}"
SQL["q88_models"] = "SELECT row_id, length(s) AS v1, length(s) - length(replace(s, ' ', '')) AS v2, md5(replace(s, ' ', '_')) AS translation_md5, 3 * length(s) AS chars FROM pool_pairs WHERE s IS NOT NULL"
