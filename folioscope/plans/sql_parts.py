"""SQL fragments shared by the oracles. Each is one or more CTEs, to be listed after WITH RECURSIVE."""

from __future__ import annotations

from folioscope.functions.vocab import (
    EXAMPLE_WORDS, IMPORTANCE_BY_TYPE, INDONESIAN_WORDS, SEMANTIC_TYPES, STOP_WORDS, TYPE_WEIGHTS,
)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words_sql(x: str) -> str:
    return rf"regexp_extract_all({x}, '\S+')"


def tokens_sql(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def marked(x: str) -> str:
    """Text with \\x01 before and \\x02 after each word: whole-word tests without \\b."""
    return rf"regexp_replace({x}, '([\p{{L}}\p{{N}}_]+)', chr(1) || '\1' || chr(2), 'g')"


def unmark(x: str) -> str:
    return f"replace(replace({x}, chr(1), ''), chr(2), '')"


CHUNKS = """
chunks AS (
  SELECT doc_id, source, lang, ((s - 1) // 450)::INT AS chunk_index, substr(text, s, 500) AS chunk_text,
         concat_ws('_', doc_id, (s - 1) // 450, substr(md5(substr(text, s, 500)), 1, 8)) AS chunk_id
  FROM (SELECT *, unnest(generate_series(1, greatest(1, length(text) - 50), 450)) AS s FROM documents))"""

ELEMENTS = r"""
lines AS (
  SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln
  FROM documents),
elems AS (
  SELECT doc_id, source, lang, ln, line, CASE WHEN length(line) <= 60 THEN 'Title' ELSE 'NarrativeText' END AS kind,
         CASE WHEN length(line) > 60 THEN (ln // 10 + 1)::INT END AS page
  FROM lines WHERE trim(line) <> ''),
pieces AS (
  SELECT doc_id, source, lang, ln, s, kind, page, substr(line, s, 1000) AS txt
  FROM (SELECT *, unnest(generate_series(1, length(line), 1000)) AS s FROM elems)),
numbered AS (
  SELECT *, (row_number() OVER w - 1)::INT AS pos, length(txt) AS n,
         last_value(CASE WHEN kind = 'Title' THEN txt END IGNORE NULLS) OVER w AS title
  FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY ln, s))"""

TITLE_CHUNKS = ELEMENTS + r""",
fill AS (
  SELECT doc_id, pos, 0 AS chunk_index, n AS len FROM numbered WHERE pos = 0
  UNION ALL
  SELECT p.doc_id, p.pos,
         CASE WHEN (p.kind = 'Title' AND f.len >= 500) OR f.len >= 800 OR f.len + 2 + p.n > 1000
              THEN f.chunk_index + 1 ELSE f.chunk_index END,
         CASE WHEN (p.kind = 'Title' AND f.len >= 500) OR f.len >= 800 OR f.len + 2 + p.n > 1000
              THEN p.n ELSE f.len + 2 + p.n END
  FROM fill f JOIN numbered p ON p.doc_id = f.doc_id AND p.pos = f.pos + 1),
tchunks0 AS (
  SELECT n.doc_id, n.source, n.lang, f.chunk_index::INT AS chunk_index,
         string_agg(n.txt, chr(10) || chr(10) ORDER BY n.pos) AS chunk_text,
         arg_min(n.page, n.pos) FILTER (WHERE n.page IS NOT NULL) AS page_number,
         first(n.title ORDER BY n.pos) AS title
  FROM fill f JOIN numbered n ON n.doc_id = f.doc_id AND n.pos = f.pos
  GROUP BY n.doc_id, n.source, n.lang, f.chunk_index),
tchunks AS (
  SELECT *, concat_ws('_', doc_id, chunk_index, substr(md5(chunk_text), 1, 8)) AS chunk_id,
         list_filter(string_split(concat_ws('/', lang, title), '/'), lambda x: x <> '') AS path_parts
  FROM tchunks0)"""


def semantic_sql(src: str, text: str) -> str:
    """CTE body: all columns of src plus semantic_type and type_score."""
    scores = []
    for name, patterns, keys, inds in SEMANTIC_TYPES:
        rx = [lit("(?im)" + p.replace(r"\w", r"[\p{L}\p{N}_]")) for p in patterns]
        p = " + ".join(f"regexp_matches({text}, {r})::INT" for r in rx)
        k = " + ".join(f"contains(lower({text}), {lit(x)})::INT" for x in keys)
        i = " + ".join(f"contains(lower({text}), {lit(x)})::INT" for x in inds)
        s = (f"(({p})::DOUBLE / {len(rx)}e0) * {TYPE_WEIGHTS['pattern']}e0"
             f" + (({k})::DOUBLE / {len(keys)}e0) * {TYPE_WEIGHTS['keyword']}e0"
             f" + (({i})::DOUBLE / {len(inds)}e0) * {TYPE_WEIGHTS['indicator']}e0")
        if name == "EXAMPLE":
            sents = rf"list_filter(string_split_regex({text}, '[.!?]+'), lambda x: {trim_sql('x')} <> '')"
            hit = r"'(?i)\x01(?:" + "|".join(EXAMPLE_WORDS) + r")\x02'"
            s += (f" + (len(list_filter({sents}, lambda y: regexp_matches({marked('y')}, {hit})))::DOUBLE"
                  f" / greatest(len({sents}), 1)) * {TYPE_WEIGHTS['linguistic']}e0")
        scores.append(s)
    names = "[" + ", ".join(lit(n) for n, *_ in SEMANTIC_TYPES) + "]"
    return f"""
SELECT * EXCLUDE (_s),
       CASE WHEN list_max(_s) >= 0.5e0 THEN {names}[list_position(_s, list_max(_s))] ELSE 'GENERAL' END AS semantic_type,
       CASE WHEN list_max(_s) >= 0.5e0 THEN list_max(_s) ELSE 1.0e0 END AS type_score
FROM (SELECT *, [{', '.join(scores)}] AS _s FROM {src})"""


def language_sql(name: str, src: str, keys: str, text: str) -> str:
    """CTEs ending in ``name``: keys, lang, confidence, id_hits."""
    langs = list(STOP_WORDS)
    profile = ", ".join(f"({lit(la)}, {lit(w)})" for la, ws in STOP_WORDS.items() for w in sorted(set(ws.split())))
    hits = " + ".join(rf"regexp_matches(m, '\x01{p}\x02')::INT" for p in INDONESIAN_WORDS)
    cols = ", ".join(f"count(*) FILTER (WHERE plang = {lit(la)}) AS h_{la}" for la in langs)
    arr = "[" + ", ".join(f"h_{la}" for la in langs) + "]"
    total = " + ".join(f"h_{la}" for la in langs)
    on = " AND ".join(f"b.{k.strip()} = h.{k.strip()}" for k in keys.split(","))
    return f"""
{name}_b AS (SELECT {keys}, {trim_sql(text)} AS body FROM {src}),
{name}_p AS (SELECT {keys}, {hits} AS id_hits, len({words_sql('body')}) AS n_words, length(body) AS n_chars
  FROM (SELECT *, {marked('lower(body)')} AS m FROM {name}_b)),
{name}_w(plang, term) AS (VALUES {profile}),
{name}_h AS (SELECT {keys}, {cols} FROM (SELECT {keys}, unnest({tokens_sql('body')}) AS term FROM {name}_b) t
  JOIN {name}_w USING (term) GROUP BY {keys}),
{name}_g AS (SELECT b.*, CASE WHEN {total} > 0 THEN {[la for la in langs]}[list_position({arr}, list_max({arr}))] ELSE 'en' END AS guess,
         CASE WHEN {total} > 0 THEN list_max({arr})::DOUBLE / ({total})::DOUBLE ELSE 0e0 END AS conf
  FROM {name}_p b LEFT JOIN {name}_h h ON {on}),
{name} AS (SELECT {keys},
    CASE WHEN n_chars < 5 THEN 'en' WHEN id_hits >= 2 AND n_words > 3 THEN 'id'
         WHEN guess = 'en' AND conf < 0.8e0 AND id_hits > 0 THEN 'id' ELSE guess END AS lang,
    CASE WHEN n_chars < 5 THEN 0e0 WHEN id_hits >= 2 AND n_words > 3 THEN 0.9e0
         WHEN guess = 'en' AND conf < 0.8e0 AND id_hits > 0 THEN 0.7e0 + id_hits / (n_words * 2e0) ELSE conf END AS confidence,
    id_hits::INT AS id_hits
  FROM {name}_g)"""


def phrases_sql(x: str) -> tuple[str, str, str, str]:
    """Names, numbers, quotes and terms of a text, each a list."""
    m, ml = marked(x), marked(f"lower({x})")
    names = rf"regexp_extract_all({m}, '\x01([A-Z][a-zA-Z]*\x02(?:\s+\x01[A-Z][a-zA-Z]*\x02)*)', 1)"
    units = "percent|kg|km|miles|dollars|euros"
    numbers = (rf"regexp_extract_all({ml}, '\x01(\d+(?:\x02[.,]\x01\d+)?"
               rf"(?:\x02?\s*\x01?(?:{units})\x02|\x02\s*%\x01|\x02))', 1)")
    quotes = f"""regexp_extract_all({x}, '"([^"]+)"', 1)"""
    terms = rf"regexp_extract_all({m}, '\x01((?:[A-Z][a-z]+(?:\d+)?|[A-Z]{{2,}})\x02)', 1)"
    clean = [f"list_transform({e}, lambda q: {unmark('q')})" for e in (names, numbers)]
    return clean[0], clean[1], quotes, f"list_transform({terms}, lambda q: {unmark('q')})"


def key_phrases_sql(x: str) -> str:
    a, b, c, d = phrases_sql(x)
    return f"list_distinct(list_concat(list_concat({a}, {b}), list_concat({c}, {d})))"


def normalize_list_sql(x: str) -> str:
    word = (r"CASE WHEN regexp_matches(substr(w, 2), '\p{Lu}') THEN w ELSE lower(w) END")
    cleaned = rf"""regexp_replace({x}, '[^\p{{L}}\p{{N}}_\s.,!?"'']', ' ', 'g')"""
    return (rf"list_transform(string_split_regex({cleaned}, '[.!?]+'), "
            rf"lambda s: array_to_string(list_transform({words_sql('s')}, lambda w: {word}), ' '))")


def word_grams_sql(x: str, n: int = 3) -> str:
    w = words_sql(f"lower({x})")
    return (f"list_distinct(list_transform(range(1, greatest(len({w}) - {n - 2}, 1)), "
            f"lambda i: array_to_string(({w})[i:i + {n - 1}], ' ')))")


def char_grams_sql(x: str, n: int = 3) -> str:
    return (f"list_distinct(list_transform(range(1, greatest(length({x}) - {n - 2}, 1)), "
            f"lambda i: substr(lower({x}), i, {n})))")


def jaccard_sql(a: str, b: str) -> str:
    return (f"(len(list_intersect({a}, {b}))::DOUBLE / greatest(len(list_distinct(list_concat({a}, {b}))), 1))")


def importance_weight_sql(x: str) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {v}e0" for k, v in IMPORTANCE_BY_TYPE.items())
    return f"CASE lower({x}) {whens} ELSE 0.5e0 END"
