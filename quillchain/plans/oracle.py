"""DuckDB SQL for the queries of ``queries``, in window form where they are narrow there."""

from __future__ import annotations

from ..functions.text import ABBREVIATIONS, ALPHABET, BOS, CLEANER_VERSION, EOS, PUNCT_FROM, PUNCT_TO, QUOTED, SPACES_AFTER, SPACES_BEFORE, TOKEN
from ..operators.query import NOISY_OPENERS, STOPWORDS

_TO = PUNCT_TO.replace("'", "''")
_FROM = PUNCT_FROM.replace("'", "''")
_RX = TOKEN.replace("'", "''")


def _clean(c: str, lowercase: bool = True) -> str:
    x = rf"regexp_replace(regexp_replace(translate({c}, '{_FROM}', '{_TO}'), '[\p{{Cc}}\p{{Cf}}]', ' ', 'g'), '\.{{3,}}', '{'...' if lowercase else '…'}', 'g')"
    if lowercase:
        x = f"lower(translate({x}, 'Iİ', 'ıi'))"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _toks(c: str) -> str:
    return rf"regexp_extract_all(regexp_replace({c}, '\.{{3,}}', '…', 'g'), '{_RX}')"


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


PARA = rf"""
lines AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n(?:[\s\x0b\x1c-\x1f]*\n)+')) AS raw, generate_subscripts(regexp_split_to_array(text, '\n(?:[\s\x0b\x1c-\x1f]*\n)+'), 1) AS k FROM documents WHERE text IS NOT NULL),
kept AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS para_no, raw FROM lines WHERE trim(regexp_replace(raw, '[\s\x0b\x1c-\x1f]+', '', 'g')) <> ''),
para AS (SELECT doc_id, CAST(para_no AS INTEGER) AS para_no, {_clean('raw')} AS clean FROM kept WHERE {_clean('raw')} <> '')"""
TOK = PARA + rf""",
arr AS (SELECT doc_id, para_no, {_toks('clean')} AS a FROM para),
tok AS (SELECT doc_id, para_no, unnest(a) AS token, unnest(range(len(a))) AS pos FROM arr)"""
CWORD = r""",
part AS (SELECT doc_id, para_no, pos, unnest(string_split(token, '-')) AS p, generate_subscripts(string_split(token, '-'), 1) AS k FROM tok WHERE regexp_matches(token, '[\p{L}\p{N}]')),
cw0 AS (SELECT doc_id, para_no, pos, k, replace(p, '''', '') AS w FROM part)"""
CW = CWORD + f""",
cw AS (SELECT * FROM cw0 WHERE length(w) BETWEEN 1 AND 64 AND regexp_matches(w, '^[{ALPHABET}]+$'))"""
SENT = f""",
f1 AS (SELECT *, CASE WHEN token IN ('.', '!', '?', '…') AND NOT (token = '.' AND coalesce(lag(token) OVER (PARTITION BY doc_id, para_no ORDER BY pos) IN {_in(ABBREVIATIONS)}, FALSE)) THEN 1 ELSE 0 END AS e,
  CASE WHEN token IN ('.', '!', '?', '…', '"', ')', ']', '}}') THEN 0 ELSE 1 END AS o FROM tok),
f2 AS (SELECT *, sum(o) OVER (PARTITION BY doc_id, para_no ORDER BY pos) AS g FROM f1),
f3 AS (SELECT doc_id, para_no, g, max(e) AS he FROM f2 GROUP BY ALL),
f4 AS (SELECT *, coalesce(sum(he) OVER (PARTITION BY doc_id, para_no ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM f3),
st AS (SELECT f2.doc_id, f2.para_no, f4.s AS sent_no, f2.pos, f2.token FROM f2 JOIN f4 USING (doc_id, para_no, g))"""
SENTENCES = ", ss AS (SELECT doc_id, para_no, CAST(sent_no AS INTEGER) AS sent_no, string_agg(token, ' ' ORDER BY pos) AS sentence, CAST(count(*) AS INTEGER) AS n_tokens FROM st GROUP BY ALL)"


def _windows(rows: str, key: str, pos: str, item: str, order: int, mode: str, name: str = "m") -> str:
    """Counted order-N windows of ``item`` in ``rows``, per ``key``, by ``pos``."""
    lags = ", ".join(f"coalesce(lag({item}, {order - i}) OVER w, '{BOS}') AS c{i}" for i in range(order))
    ends = ", ".join(f"coalesce(list_extract(l, -{order - i}), '{BOS}')" for i in range(order))
    state = " || chr(31) || ".join(f"c{i}" for i in range(order))
    cs = ", ".join(f"c{i}" for i in range(order))
    return f""",
{name}_w AS (SELECT {lags}, {item} AS nx FROM {rows} WINDOW w AS (PARTITION BY {key} ORDER BY {pos})),
{name}_l AS (SELECT list({item} ORDER BY {pos}) AS l FROM {rows} GROUP BY {key}),
{name}_e AS (SELECT {ends}, '{EOS}' FROM {name}_l),
{name}_a AS (SELECT * FROM {name}_w UNION ALL SELECT * FROM {name}_e),
{name} AS (SELECT '{mode}' AS mode, {state} AS state, nx AS next_token, count(*) AS frequency FROM {name}_a GROUP BY {cs}, nx)"""


def _words(order: int, name: str = "m") -> str:
    return _windows("st", "doc_id, para_no, sent_no", "pos", "token", order, "word", name)


def _chars(order: int, name: str = "m") -> str:
    rows = f", {name}_c AS (SELECT doc_id, para_no, pos, k, unnest(string_split(w, '')) AS ch, generate_subscripts(string_split(w, ''), 1) AS i FROM cw)"
    return rows + _windows(f"{name}_c", "doc_id, para_no, pos, k", "i", "ch", order, "char", name)


def _back(src: str = "m", name: str = "b") -> str:
    return f", {name} AS (SELECT mode, list_extract(string_split(state, chr(31)), -1) AS last_token, next_token, CAST(sum(frequency) AS BIGINT) AS frequency FROM {src} GROUP BY ALL)"


WORD2 = "WITH " + TOK + SENT + _words(2)
PROMPT = f""",
pr0 AS (SELECT item_id AS id, {_toks(_clean('text'))} AS tokens FROM benchmark),
pr AS (SELECT id, tokens, list_slice(tokens, 1, 2) AS output FROM pr0)"""


def _context(toks: str, order: int) -> str:
    return f"array_to_string(list_slice(list_concat(list_value({', '.join([chr(39) + BOS + chr(39)] * order)}), {toks}), -{order}, -1), chr(31))"


def _dist(t: float) -> str:
    if t == 0:
        weight = "CASE WHEN next_token = arg_max(next_token, (frequency, next_token)) OVER (PARTITION BY state) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    else:
        weight = f"exp((ln(frequency) - ln(max(frequency) OVER (PARTITION BY state))) / {t}::DOUBLE)"
    return WORD2 + f", x AS (SELECT state, next_token, frequency, {weight} AS w FROM m) SELECT state, next_token, frequency, round(w / sum(w) OVER (PARTITION BY state) + 1e-9, 6) AS probability FROM x"


def _walk(head: str, joiner: str, steps: int = 6) -> str:
    """Greedy steps as a recursive query; ``head`` defines m, b and p0 (id, state, output)."""
    return head.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
g AS (SELECT state, arg_max(next_token, (frequency, next_token)) AS nx FROM m GROUP BY state),
h AS (SELECT last_token, arg_max(next_token, (frequency, next_token)) AS nx FROM b WHERE last_token <> '{BOS}' GROUP BY last_token),
k(id, state, output, step) AS (
  SELECT id, state, output, 0 FROM p0
  UNION ALL
  SELECT id, CASE WHEN go THEN array_to_string(list_concat(list_slice(string_split(state, chr(31)), 2, -1), list_value(nx)), chr(31)) END, CASE WHEN go THEN list_concat(output, list_value(nx)) ELSE output END, step + 1
  FROM (SELECT k.*, coalesce(g.nx, h.nx) AS nx, coalesce(coalesce(g.nx, h.nx) <> '{EOS}', FALSE) AS go FROM k LEFT JOIN g ON k.state = g.state LEFT JOIN h ON h.last_token = list_extract(string_split(k.state, chr(31)), -1) WHERE step < {steps}))
SELECT id, array_to_string(output, '{joiner}') AS walk FROM k WHERE step = {steps}"""


_TOPIC = f""",
lx AS (SELECT id, list_distinct(list_filter(tokens, lambda t: regexp_matches(t, '[\\p{{L}}\\p{{N}}]'))) AS l FROM pr),
tp AS (SELECT id, unnest(CASE WHEN len(list_filter(l, lambda t: t NOT IN {_in(STOPWORDS)})) > 0 THEN list_filter(l, lambda t: t NOT IN {_in(STOPWORDS)}) ELSE l END) AS token FROM lx),
ts AS (SELECT id, token, CAST(greatest(1.0, round_even(1000000 / sqrt(frequency), 0)) AS BIGINT) AS weight FROM tp JOIN m ON m.next_token = tp.token WHERE m.state = '{BOS}' || chr(31) || '{BOS}')"""
_U = "CAST(('0x' || substr(md5(state), 1, 12)) AS BIGINT)::DOUBLE / 281474976710656.0"


def _detok(s: str) -> str:
    return rf"""trim(regexp_replace(regexp_replace(regexp_replace({s}, '{SPACES_BEFORE}', '\1', 'g'), '{SPACES_AFTER}', '\1', 'g'), '{QUOTED}', '"\1"', 'g'))"""


def _values(*rows) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


ORACLE_SQL = {
    "clean_text_docs": f"SELECT doc_id, {_clean('text')} AS clean FROM documents",
    "clean_text_cased": f"SELECT doc_id, {_clean('text', False)} AS clean FROM documents",
    "paragraphs_docs": f"WITH {PARA} SELECT * FROM para",
    "tokenize_docs": f"WITH {TOK} SELECT doc_id, para_no, CAST(pos AS INTEGER) AS pos, token FROM tok",
    "lexical_token_counts": rf"WITH {TOK} SELECT token, count(*) AS n FROM tok WHERE regexp_matches(token, '[\p{{L}}\p{{N}}]') GROUP BY token",
    "sentences_docs": f"WITH {TOK}{SENT}{SENTENCES} SELECT * FROM ss",
    "detokenize_sentences": f"WITH {TOK}{SENT}{SENTENCES} SELECT doc_id, para_no, sent_no, {_detok('sentence')} AS shown FROM ss",
    "char_words": f"WITH {TOK}{CW} SELECT w AS word, count(*) AS n FROM cw GROUP BY w",
    "char_words_loose": rf"WITH {TOK}{CWORD} SELECT w AS word, count(*) AS n FROM cw0 WHERE length(w) BETWEEN 2 AND 12 AND regexp_matches(w, '^\p{{L}}+$') GROUP BY w",
    **{f"word_transitions_o{n}": "WITH " + TOK + SENT + _words(n) + " SELECT * FROM m" for n in (1, 2, 3)},
    **{f"char_transitions_o{n}": "WITH " + TOK + CW + _chars(n) + " SELECT * FROM m" for n in (2, 3)},
    "word_backoff": WORD2 + _back() + " SELECT * FROM b",
    "char_backoff": "WITH " + TOK + CW + _chars(2) + _back() + " SELECT * FROM b",
    "model_row_counts": "WITH " + TOK + SENT + CW + _words(2) + _chars(2, "c") + " SELECT mode, count(*) AS transition_rows FROM (SELECT * FROM m UNION ALL SELECT * FROM c) GROUP BY mode",
    "build_stats": "WITH " + TOK + SENT + CW + rf""" SELECT (SELECT count(*) FROM para) AS paragraphs, (SELECT count(*) FROM tok WHERE regexp_matches(token, '[\p{{L}}\p{{N}}]')) AS word_tokens, (SELECT count(*) FROM cw) AS character_words,
 CAST((SELECT count(*) FROM st) + (SELECT count(*) FROM (SELECT DISTINCT doc_id, para_no, sent_no FROM st)) + (SELECT sum(length(w) + 1) FROM cw) AS BIGINT) AS observations,
 (SELECT count(*) FROM documents) AS source_files, (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM documents) AS source_bytes""",
    "source_totals": "SELECT source, count(*) AS source_files, CAST(sum(strlen(text)) AS BIGINT) AS source_bytes FROM documents GROUP BY source",
    "exact_lookup": WORD2 + f" SELECT next_token, frequency FROM m WHERE state = '{BOS}' || chr(31) || '{BOS}'",
    "backoff_lookup": WORD2 + _back() + " SELECT next_token, frequency FROM b WHERE last_token = 'the'",
    "transition_frequency": WORD2 + PROMPT + f", q AS (SELECT DISTINCT 'word' AS mode, {_context('output', 2)} AS state, list_extract(tokens, 3) AS next_token FROM pr WHERE len(tokens) >= 3) SELECT q.mode, q.state, q.next_token, coalesce(m.frequency, 0) AS frequency FROM q LEFT JOIN m USING (mode, state, next_token)",
    "candidates_with_backoff": WORD2 + _back() + PROMPT + """, q AS (SELECT id, concat_ws(chr(31), list_extract(tokens, 1), list_extract(tokens, 3)) AS state FROM pr)
SELECT id, state, next_token, frequency, 'exact' AS source FROM q JOIN m USING (state)
UNION ALL SELECT id, q.state, b.next_token, b.frequency, 'backoff' FROM q JOIN b ON b.last_token = list_extract(string_split(q.state, chr(31)), -1) WHERE b.last_token <> '""" + BOS + "' AND q.state NOT IN (SELECT state FROM m)",
    "greedy_next": WORD2 + " SELECT state, arg_max(next_token, (frequency, next_token)) AS next_token, max(frequency) AS frequency FROM m GROUP BY state",
    **{f"next_token_distribution_t{n}": _dist(t) for n, t in (("0", 0.0), ("05", 0.5), ("1", 1.0), ("2", 2.0))},
    "sample_next": WORD2 + f""", x AS (SELECT state, next_token, exp(ln(frequency) - ln(max(frequency) OVER (PARTITION BY state))) AS w FROM m),
y AS (SELECT state, next_token, sum(w) OVER (PARTITION BY state ORDER BY next_token) AS cum, sum(w) OVER (PARTITION BY state) AS total, {_U} AS u FROM x)
SELECT state, coalesce(min(next_token) FILTER (WHERE cum > u * total), max(next_token)) AS next_token FROM y GROUP BY state""",
    "topic_starts": WORD2 + PROMPT + _TOPIC + " SELECT id, token, weight FROM ts",
    "topic_restarts": WORD2 + PROMPT + _TOPIC + """, an AS (SELECT id, arg_min(token, (-weight, token)) AS anchor FROM ts GROUP BY id),
gr AS (SELECT id, unnest(list_zip(tokens[1:-2], tokens[2:])) AS z FROM pr WHERE len(tokens) >= 2)
SELECT DISTINCT id, anchor, z[1] || ' ' || z[2] AS phrase FROM gr JOIN an USING (id) WHERE z[1] = anchor OR z[2] = anchor""",
    "no_repeat_filter": "WITH " + TOK + SENT + _words(1) + PROMPT + """, q AS (SELECT id, tokens, next_token, frequency FROM pr JOIN m ON m.state = list_extract(tokens, -1) WHERE len(tokens) > 0),
tg AS (SELECT id, unnest(list_transform(range(1, len(tokens) - 1), lambda i: array_to_string(list_slice(tokens, i, i + 2), chr(31)))) AS t FROM pr WHERE len(tokens) >= 3),
r AS (SELECT q.*, len(tokens) < 2 OR (id, list_extract(tokens, -2) || chr(31) || list_extract(tokens, -1) || chr(31) || next_token) NOT IN (SELECT (id, t) FROM tg) AS fresh FROM q),
v AS (SELECT *, bool_or(fresh) OVER (PARTITION BY id) AS any_left FROM r)
SELECT id, next_token, frequency FROM v WHERE fresh OR NOT any_left""",
    "noisy_opener_filter": "WITH " + TOK + SENT + _words(1) + f", v AS (SELECT *, next_token NOT IN {_in(NOISY_OPENERS)} AS ok, bool_or(next_token NOT IN {_in(NOISY_OPENERS)}) OVER (PARTITION BY state) AS any_left FROM m) SELECT state, next_token, frequency FROM v WHERE ok OR NOT any_left",
    "state_encode_decode": "WITH x AS (SELECT 1)" + PROMPT + " SELECT id, array_to_string(tokens, chr(31)) AS state, CAST(len(tokens) AS INTEGER) AS n, list_extract(tokens, -1) AS last_token FROM pr WHERE len(tokens) > 0",
    "merge_models": WORD2 + " SELECT * FROM m",
    "generator_context": "WITH x AS (SELECT 1)" + PROMPT + " SELECT id, " + ", ".join(f"{_context(f'list_slice(tokens, 1, {n})', 3)} AS after_{n}" for n in (1, 2, 5)) + " FROM pr",
    "output_trigrams": "WITH x AS (SELECT 1)" + PROMPT + " SELECT DISTINCT id, unnest(list_transform(range(1, len(tokens) - 1), lambda i: array_to_string(list_slice(tokens, i, i + 2), ' '))) AS trigram FROM pr WHERE len(tokens) >= 3",
    "greedy_walk_word": _walk(WORD2 + _back() + PROMPT + f", p0 AS (SELECT id, {_context('output', 2)} AS state, output FROM pr)", " "),
    "greedy_walk_char": _walk("WITH " + TOK + CW + _chars(2) + _back() + PROMPT + rf""",
cp AS (SELECT id, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS i FROM pr), cq AS (SELECT id, i, unnest(string_split(t, '-')) AS p, generate_subscripts(string_split(t, '-'), 1) AS j FROM cp WHERE regexp_matches(t, '[\p{{L}}\p{{N}}]')),
cr AS (SELECT id, arg_min(replace(p, '''', ''), (i, j)) AS w FROM cq WHERE length(replace(p, '''', '')) BETWEEN 1 AND 64 AND regexp_matches(replace(p, '''', ''), '^[{ALPHABET}]+$') GROUP BY id),
p0 AS (SELECT id, {_context("string_split(w[1:2], '')", 2)} AS state, string_split(w[1:2], '') AS output FROM cr)""", ""),
    "turkish_lower_fixture": "SELECT * FROM (VALUES " + _values((0, "ı i i ı"), (1, "ığdır izmir kış ışığı"), (2, "istanbul"), (3, "kâğıt millî sükûn"), (4, "fırat abc 1⁄2".replace("fırat", "firat"))) + ") v(id, clean)",
    "punct_fixture": "SELECT * FROM (VALUES " + _values((0, "ankara'da, izmir'de; türkiye'nin", "ankara'da|,|izmir'de|;|türkiye'nin"), (1, "a " + chr(0x301) + "b", "a|b"), (2, "bekle... dur... son...", "bekle|…|dur|…|son|…"), (3, "a bc d", "a|bc|d"), (4, '"x" "y" - - -', '"|x|"|"|y|"|-|-|-'), (5, "42abc 2024-01-02 3'te café42 a_b", "42|abc|2024|-|01|-|02|3|te|café42|a|b")) + ") v(id, clean, tokens)",
    "sentence_fixture": "SELECT * FROM (VALUES " + _values((0, "dr . ali geldi . # sonra gitti !"), (1, '" merhaba . " # sonra ( gitti ! )'), (2, 'dedi . " # gel "'), (3, "prof . dr . can ; bkz . s . # 5 … # evet ? ! # ( son )"), (4, "noktasız cümle")) + ") v(id, sentences)",
    "paragraph_fixture": "SELECT * FROM (VALUES " + _values((1, 0, "bir iki"), (1, 1, "üç"), (1, 2, "dört beş")) + ") v(doc_id, para_no, clean)",
    "event_transitions": "WITH ev AS (SELECT * FROM events WHERE user_id IS NOT NULL)" + _windows("ev", "user_id", "ts, event_id", "event_type", 2, "event") + " SELECT * FROM m",
    "stored_transitions": WORD2 + " SELECT * FROM m",
    "stored_backoff": WORD2 + _back() + " SELECT * FROM b",
    "corpus_files": WORD2 + " SELECT * FROM m",
    "stored_catalog": "WITH " + TOK + SENT + CW + _words(2) + _chars(2, "c") + f""" SELECT CAST(CASE mode WHEN 'word' THEN 1 ELSE 2 END AS INTEGER) AS id, mode, CAST(2 AS INTEGER) AS state_size, '{CLEANER_VERSION}' AS cleaner_version, TRUE AS complete, count(*) AS transition_rows
FROM (SELECT * FROM m UNION ALL SELECT * FROM c) GROUP BY mode""",
    "stored_metadata": "WITH " + TOK + SENT + CW + _words(2) + _chars(2, "c") + f""" SELECT * FROM (VALUES ('build_complete', '1'), ('cleaner_version', '{CLEANER_VERSION}'), ('encoding', 'utf-8'), ('modes', '["word", "char"]'), ('order', '2'), ('schema_version', '1')) v(key, value)
UNION ALL SELECT 'transition_rows', '{{"word": ' || (SELECT count(*) FROM m) || ', "char": ' || (SELECT count(*) FROM c) || '}}'""",
    "char_prompts": "SELECT * FROM (VALUES " + _values((0, "ış", None), (1, "iki", "a character prompt is one word at most"), (2, "", None), (3, "aksulu", None), (4, "qwx", "a character prompt keeps to the Turkish alphabet"), (5, "a1", "a character prompt has letters only"), (6, "", None)) + ") v(id, word, problem)",
}
