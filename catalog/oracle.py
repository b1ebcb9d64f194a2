"""The same results in SQL, written the relational way.

Where the Spark side works inside a document's row, the SQL side uses windows
and joins over lines; words are cut by masking and unmasking; positions of
matches come from splitting at marked matches.
"""

from __future__ import annotations

from catalog import corpora as C
from catalog.queries import PARA_KEYS
from galley.functions import fixed_values as fx
from galley.functions.re2 import UNICODE_SPACE
from galley.operators.line_checks import LINE_CHECKS, no_comma_pattern, no_period_pattern

BR = "chr(10)"


def q(text: str) -> str:
    """An SQL string literal; control characters are spelled out."""
    parts, plain = [], ""
    for ch in text:
        if ord(ch) < 32:
            if plain:
                parts.append(plain)
                plain = ""
            parts.append(ch)
        else:
            plain += ch
    if plain:
        parts.append(plain)
    if not parts:
        return "''"
    shown = [
        f"chr({ord(p)})" if ord(p[0]) < 32 else "'" + p.replace("'", "''") + "'" for p in parts
    ]
    return shown[0] if len(shown) == 1 else "(" + " || ".join(shown) + ")"


SPACES = q(UNICODE_SPACE)


def has(text: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {q(p)})" for p in patterns) + ")"


def src(seeds=None, table="documents", key="doc_id", text="text", where="TRUE") -> str:
    expr = f"coalesce({text}, '')"
    for old, new in seeds or []:
        expr = f"replace({expr}, {q(old)}, {q(new)})"
    return f"src AS (SELECT {key} AS doc_id, {expr} AS text FROM {table} WHERE {where})"


LINES = rf"""
cut AS (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE string_split_regex(
    regexp_replace(regexp_replace(text, '^\x{{FEFF}}', ''), '\r?\n\z', ''), '\r?\n') END AS a FROM src),
num AS (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS line_no FROM cut),
l AS MATERIALIZED (SELECT doc_id, line_no, a[line_no] AS text FROM num)"""

NEAR = """
w AS MATERIALIZED (SELECT *, lag(text) OVER o AS before, lead(text) OVER o AS after
    FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY line_no))"""

PARAS = """
isl AS (SELECT *, sum(CASE WHEN text = '' THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM l),
blk AS (SELECT doc_id, g, min(line_no) AS first_line, max(line_no) AS last_line,
    string_agg(text, ' ' ORDER BY line_no) AS text FROM isl WHERE text <> '' GROUP BY doc_id, g),
p AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS para_no,
    first_line, last_line, text FROM blk)"""


def twice(expr: str, pattern: str, to: str) -> str:
    once = f"regexp_replace({expr}, {q(pattern)}, {q(to)}, 'g')"
    return f"regexp_replace({once}, {q(pattern)}, {q(to)}, 'g')"


def line_words_sql(text: str) -> str:
    m = twice(text, r"(\p{L})-(\p{L})", r"\1①\2")
    m = twice(m, r"(\p{L})’(\p{L})", r"\1②\2")
    m = twice(m, r"(\p{L})‘(\p{L})", r"\1③\2")
    m = twice(m, r"(\P{L}|^)’(\p{L})", r"\1②\2")
    return (
        rf"list_transform(regexp_extract_all({m}, '[\p{{L}}\p{{N}}]+'), "
        "lambda x: replace(replace(replace(x, '①', '-'), '②', '’'), '③', '‘'))"
    )


def book_words_sql(text: str) -> str:
    m = twice(text, r"(\p{L})'(\p{L})", r"\1①\2")
    m = twice(m, r"(\p{L})’(\p{L})", r"\1②\2")
    return (
        rf"list_transform(regexp_extract_all(replace({m}, '--', ' '), '[\p{{L}}\p{{N}}-]+'), "
        "lambda x: replace(replace(x, '①', ''''), '②', '’'))"
    )


def spell_words_sql(text: str) -> str:
    m = twice(text, r"(\p{L})'(\p{L})", r"\1①\2")
    m = twice(m, r"(\p{L})’(\p{L})", r"\1②\2")
    return (
        rf"list_transform(regexp_extract_all({m}, '\p{{L}}[\p{{L}}①②]*'), "
        "lambda x: replace(replace(x, '①', ''''), '②', '’'))"
    )


def upper_sql(w: str) -> str:
    """Upper case letter for letter: the sharp s has none."""
    return f"replace(upper({w}), 'ẞ', 'ß')"


def title_sql(w: str) -> str:
    starts = r"^[\x00-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7f\x{85}\p{Z}]$"
    return (
        f"array_to_string(list_transform(range(1, length({w}) + 1), lambda i: CASE WHEN i = 1 OR "
        f"regexp_matches(substr({w}, i - 1, 1), {q(starts)}) THEN {upper_sql(f'substr({w}, i, 1)')} "
        f"ELSE substr({w}, i, 1) END), '')"
    )


TOKENS = f"""
t AS MATERIALIZED (SELECT doc_id, line_no, text, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS word_no
    FROM (SELECT *, {line_words_sql("text")} AS ws FROM l))"""
POSTINGS = f"""
b AS MATERIALIZED (SELECT doc_id, line_no, unnest({book_words_sql("text")}) AS word FROM l)"""
VOCAB = """
v AS MATERIALIZED (SELECT doc_id, word, count(*) AS n FROM b GROUP BY doc_id, word)"""


def with_context(relation: str, keep: str, text: str = "text", at: str = "pos") -> str:
    """``SELECT keep, context`` around the 0-based position ``at``."""
    side, width = fx.CONTEXT_SIDE, fx.CONTEXT_WIDTH
    return rf"""
SELECT {keep}, replace(replace(trim(substr(_t, _s + 1, _e - _s), {SPACES}), '  ', ' '), '  ', ' ') AS context
FROM (SELECT *,
    CASE WHEN _lo > 0 AND strpos(substr(_t, 1, _lo + 1), ' ') > 0
         THEN _lo - length(regexp_extract(substr(_t, 1, _lo + 1), '[^ ]*$')) ELSE 0 END AS _s,
    CASE WHEN _hi < _n AND strpos(substr(_t, _hi + 1), ' ') > 0
         THEN _hi + strpos(substr(_t, _hi + 1), ' ') - 1 ELSE _n END AS _e
  FROM (SELECT *, greatest(CASE WHEN _r >= _n THEN _n - {width} WHEN _l < 0 THEN 0 ELSE _l END, 0) AS _lo,
        least(_r, _n) AS _hi
      FROM (SELECT *, {text} AS _t, length({text}) AS _n, {at} - {side} AS _l,
            CASE WHEN {at} < {side} THEN {width} ELSE {at} + {side} END AS _r FROM ({relation}))))"""


def spans(relation: str, keys: str, text: str, pattern: str) -> str:
    """Every match with its 0-based position: ``keys, text, at, item``."""
    marked = f"regexp_replace({text}, {q('(' + pattern + ')')}, {q(chr(1) + chr(92) + '1' + chr(2))}, 'g')"
    first_only = marked
    return f"""
SELECT {keys}, {text} AS text, pos::BIGINT AS pos, split_part(piece, chr(2), 1) AS item FROM (
  SELECT *, sum(length(replace(piece, chr(2), ''))) OVER (PARTITION BY {keys} ORDER BY k
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pos
  FROM (SELECT {keys}, {text}, unnest(ps) AS piece, unnest(range(1, len(ps) + 1)) AS k
        FROM (SELECT {keys}, {text}, string_split({first_only}, chr(1)) AS ps FROM ({relation}))))
WHERE k > 1"""


def ctes(*parts: str) -> str:
    return "WITH " + ",".join(parts)


# --------------------------------------------------------------- line checks


def dash_sql() -> str:
    expr = "CASE WHEN before = '' THEN regexp_replace(text, '—', '') ELSE text END"
    for pattern, to in fx.DASH_LEGAL:
        expr = f"regexp_replace({expr}, {q(pattern)}, {q(chr(92) + '1—' + chr(92) + '2' if to == '—' else to)}, 'g')"
    expr = f"regexp_replace({expr}, {q(fx.DASH_LINE_END)}, '', 'g')"
    classes = " ".join(f"WHEN contains(d, {q(c)}) THEN {q(name)}" for name, c in fx.DASH_CLASSES)
    return (
        f"SELECT doc_id, line_no, text, CASE WHEN regexp_matches(d, {q(fx.DASH_ADJACENT)}) "
        f"THEN 'adjacent dashes' {classes} ELSE 'unrecognized dash' END AS rule "
        f"FROM (SELECT *, {expr} AS d FROM w) WHERE regexp_matches(d, {q(fx.DASH_ANY)})"
    )


def special_rules() -> list[tuple[str, str]]:
    rules = [("paragraph ends in comma", "ends_with(text, ',') AND after = ''")]
    for name, hits, excuses in fx.SPECIAL_LINE_RULES:
        cond = has("text", *hits)
        rules.append((name, f"{cond} AND NOT {has('text', *excuses)}" if excuses else cond))
    for name, parts in fx.SPECIAL_SUBSTRING_RULES:
        rules.append((name, "(" + " OR ".join(f"contains(text, {q(s)})" for s in parts) + ")"))
    rules.append(("unexpected comma after word", has("lower(text)", no_comma_pattern())))
    rules.append(("unexpected period after word", has("lower(text)", no_period_pattern())))
    return rules


def line_rules(check: str) -> list[tuple[str, str]]:
    return {
        "asterisks": [("asterisks", "contains(text, '*')")],
        "adjacent spaces": [("adjacent spaces", f"contains(trim(text, {SPACES}), '  ')")],
        "trailing spaces": [("trailing spaces", "ends_with(text, ' ')")],
        "short lines": [
            (
                "short lines",
                f"NOT starts_with(text, ' ') AND length(text) BETWEEN 1 AND {fx.SHORT_LINE_MAX} "
                "AND coalesce(after, '') <> ''",
            )
        ],
        "long lines": [("long lines", f"length(text) > {fx.LONG_LINE_OVER}")],
        "ellipsis": [("ellipsis", has("text", *fx.ELLIPSIS))],
        "curly quotes": [
            ("floating quote", has("text", *fx.FLOATING_QUOTE)),
            ("quote direction", has("text", *fx.QUOTE_DIRECTION)),
        ],
        "special situations": special_rules(),
    }[check]


def line_hits(check: str, rules: list[str] | None = None) -> str:
    if check == "dash check":
        return f"SELECT doc_id, rule, line_no, 1::BIGINT AS n, text FROM ({dash_sql()})"
    n = "length(text)" if check == "long lines" else "1"
    return " UNION ALL ".join(
        f"SELECT doc_id, {q(rule)} AS rule, line_no, {n}::BIGINT AS n, text FROM w WHERE {cond}"
        for rule, cond in line_rules(check)
        if rules is None or rule in rules
    )


def line_check(check: str, seeds=None, rules=None) -> str:
    return ctes(src(seeds), LINES, NEAR) + line_hits(check, rules)


def all_line_hits() -> str:
    return " UNION ALL ".join(
        f"SELECT {q(c)} AS check_name, * FROM ({line_hits(c)})" for c in LINE_CHECKS
    )


# -------------------------------------------------------------- layout checks

INKED = f"""
nb AS (SELECT doc_id, line_no, trim(text, {SPACES}) AS text,
    line_no - coalesce(lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no), 0) - 1 AS gap
    FROM l WHERE trim(text, {SPACES}) <> '')"""


def spacing(seeds=C.SPACING) -> str:
    marked = "pattern"
    for d in ["3", "5", "22", "44"]:
        marked = f"replace({marked}, '{d}', '⟦{d}⟧')"
    return (
        ctes(src(seeds), LINES, INKED)
        + f""",
sg AS (SELECT *, sum(CASE WHEN gap >= {fx.CHAPTER_GAP} THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY line_no) AS s FROM nb),
agg AS (SELECT doc_id, s, min(line_no) - 1 AS label,
    regexp_replace(coalesce(string_agg(CASE WHEN gap > 0 THEN gap::VARCHAR END, '' ORDER BY line_no), ''),
        '11+1', '1..1', 'g') AS pattern FROM sg GROUP BY doc_id, s),
al AS (SELECT src.doc_id, 0 AS s FROM src UNION SELECT doc_id, s FROM agg),
f AS (SELECT al.doc_id, al.s, CASE WHEN al.s = 0 THEN 0 ELSE label END AS label,
    coalesce(pattern, '') AS pattern, al.s = max(al.s) OVER (PARTITION BY al.doc_id) AS is_last
    FROM al LEFT JOIN agg ON al.doc_id = agg.doc_id AND al.s = agg.s),
g AS (SELECT doc_id, (s + 1)::BIGINT AS stretch_no, label::BIGINT AS label,
    CASE WHEN is_last THEN pattern ELSE {marked} END AS pattern FROM f)
SELECT *, contains(pattern, '⟦')::BIGINT AS suspect FROM g"""
    )


def headers(seeds=C.SPACING) -> str:
    return (
        ctes(src(seeds), LINES, INKED)
        + f""",
bl AS (SELECT *, sum(CASE WHEN gap > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM nb),
h AS (SELECT doc_id, k, min(line_no) AS line_no, arg_min(gap, line_no) AS gap,
    ' ' || string_agg(text, ' ' ORDER BY line_no) AS text FROM bl GROUP BY doc_id, k)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS header_no, line_no,
    substr(CASE WHEN length(text) > {fx.HEADER_MAX} THEN left(text, {fx.HEADER_CUT}) || '{fx.HEADER_MORE}'
        ELSE text END, 2) AS text
FROM h WHERE gap >= {fx.CHAPTER_GAP}"""
    )


def duplicates(seeds=None) -> str:
    return (
        ctes(src(seeds), LINES)
        + f""",
d AS (SELECT doc_id, text, min(line_no) AS line_no FROM l
    WHERE text <> '' AND text <> {q(fx.THOUGHT_BREAK)} GROUP BY doc_id, text HAVING count(*) > 1),
i AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM d)
SELECT doc_id, min(line_no) AS "start", max(line_no) AS "end", count(*) AS n
FROM i GROUP BY doc_id, g HAVING count(*) > 1"""
    )


def series(pattern: str, anchors: bool, seeds=C.NOTES) -> str:
    text = f"regexp_replace(text, {q('^[' + UNICODE_SPACE.replace(chr(10), '') + chr(92) + 'n]*' + chr(92) + '[' + chr(92) + 'd+' + chr(92) + ']')}, '')" if anchors else "text"
    return (
        ctes(src(seeds), LINES)
        + f""",
m AS (SELECT doc_id, line_no, unnest(xs) AS x, unnest(range(1, len(xs) + 1)) AS k
    FROM (SELECT doc_id, line_no, regexp_extract_all({text}, {q(pattern)}, 1) AS xs FROM l)),
nn AS (SELECT doc_id, line_no, k, try_cast(x AS BIGINT) AS x FROM m WHERE try_cast(x AS BIGINT) > 0),
st AS (SELECT *, CASE WHEN x = lag(x) OVER (PARTITION BY doc_id ORDER BY line_no, k) + 1 THEN 0 ELSE 1 END AS s FROM nn),
g AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY line_no, k) AS series_no FROM st)
SELECT doc_id, series_no::BIGINT AS series_no, min(x) AS "start", max(x) AS "end", count(*) AS n
FROM g GROUP BY doc_id, series_no"""
    )


def rare_chars(seeds=None) -> str:
    return (
        ctes(src(seeds), LINES)
        + f""",
c AS (SELECT doc_id, line_no, text, unnest(string_split(text, '')) AS ch FROM l WHERE text <> ''),
r AS (SELECT doc_id, ch, count(*) AS n FROM c WHERE NOT contains({q(fx.USUAL_CHARS)}, ch)
    GROUP BY doc_id, ch HAVING count(*) < {fx.RARE_BELOW})
SELECT DISTINCT doc_id, ch, n, line_no, text FROM c JOIN r USING (doc_id, ch)"""
    )


# ---------------------------------------------------------------- book checks


def counts_cte() -> str:
    cols = ", ".join(
        f'sum(len(regexp_extract_all(text, {q(p)}))) AS "{n}"' for n, p in fx.SPELLING_COUNTS
    )
    marks = ", ".join(
        f'sum(contains(text, {q(c)})::INT) AS "has {i}"' for i, c in enumerate(["'", "‘", "’", '"', "“", "”"])
    )
    turned = (
        "sum(len(list_filter(ws, lambda x: contains(x, 'M’')))) AS ma, "
        "sum(len(list_filter(ws, lambda x: contains(x, 'M‘')))) AS mt"
    )
    return (
        f"c AS MATERIALIZED (SELECT doc_id, {cols}, {marks}, {turned} "
        f"FROM (SELECT *, {line_words_sql('text')} AS ws FROM l) GROUP BY doc_id)"
    )


def book_counts() -> str:
    return (
        ctes(src(C.TYPESET), LINES, counts_cte())
        + " UNION ALL ".join(
            f'SELECT doc_id, {q(n)} AS spelling, "{n}"::BIGINT AS n FROM c' for n, _ in fx.SPELLING_COUNTS
        )
    )


def book_level(seeds=C.TYPESET) -> str:
    def shown(*names):
        return " || ' ' || ".join(f"'{n}=' || \"{n}\"::BIGINT" for n in names)

    def total(names):
        return "(" + " + ".join(f'"{n}"' for n in names) + ")"

    rules = [
        ("both straight and curly single quotes", '"has 0" > 0 AND ("has 1" > 0 OR "has 2" > 0)', "''"),
        ("both straight and curly double quotes", '"has 3" > 0 AND ("has 4" > 0 OR "has 5" > 0)', "''"),
    ]
    for a, b in fx.SPELLING_PAIRS:
        rules.append((f'both "{a}" and "{b}"', f'"{a}" > 0 AND "{b}" > 0', shown(a, b)))
    rules.append(
        (
            "compass direction hyphenation inconsistency",
            f"{total(fx.COMPASS_SOLID)} > 0 AND {total(fx.COMPASS_HYPHENED)} > 0",
            shown(*fx.COMPASS_SOLID, *fx.COMPASS_HYPHENED),
        )
    )
    for a, b in fx.TITLE_PAIRS:
        rules.append((f'both "{a}" and "{b}"', f'"{a}" > 0 AND "{b}" > 0', shown(a, b)))
    dotted, bare = [a for a, _ in fx.TITLE_PAIRS], [b for _, b in fx.TITLE_PAIRS]
    none = " AND ".join(f'NOT ("{a}" > 0 AND "{b}" > 0)' for a, b in fx.TITLE_PAIRS)
    rules.append(
        (
            "mixed American and British title punctuation",
            f"{none} AND {total(dotted)} > 0 AND {total(bare)} > 0",
            shown(*dotted, *bare),
        )
    )
    rules.append(("both apostrophes and turned commas", "ma > 0 AND mt > 0", "''"))
    return ctes(src(seeds), LINES, counts_cte()) + " UNION ALL ".join(
        f"SELECT doc_id, {q(rule)} AS rule, {item} AS item FROM c WHERE {cond}" for rule, cond, item in rules
    )


# ----------------------------------------------------------- paragraph checks


def edited() -> str:
    expr = f"regexp_replace(text, {q(fx.INITIALS_GROUP)}, '', 'g')"
    for a in fx.STOP_ABBREVIATIONS:
        expr = f"replace({expr}, {q(a)}, '')"
    for pattern in fx.STOP_NUMBERED:
        expr = f"regexp_replace({expr}, {q(pattern)}, '', 'g')"
    return expr


def para_rule(key: str, seeds=C.PARAGRAPHS) -> str:
    rule = q(PARA_KEYS[key])
    base = ctes(src(seeds), LINES, PARAS)
    keep = f"doc_id, para_no, {rule} AS rule, item"
    keys = "doc_id, para_no"
    if key == "para_upper_start":
        rel = f"SELECT *, '' AS item, 0 AS pos FROM p WHERE {has('text', fx.STARTS_UPPER)}"
    elif key == "para_split":
        rel = f"SELECT *, '' AS item, 0 AS pos FROM p WHERE {has('text', fx.SPLIT_PARAGRAPH)}"
    elif key == "para_bad_end":
        base += """, st AS (SELECT doc_id, sum(contains(text, '.’')::INT) > sum(contains(text, '.”')::INT) AS british
            FROM l GROUP BY doc_id)"""
        body = "CASE WHEN ends_with(text, '_') THEN left(text, length(text) - 1) ELSE text END"
        rel = f"""SELECT p.*, '' AS item, length(text) - 1 AS pos FROM p JOIN st USING (doc_id)
            WHERE NOT starts_with(text, ' ') AND NOT CASE WHEN british
            THEN {has(body, fx.END_BRITISH)} ELSE {has(body, fx.END_AMERICAN)} END"""
    elif key == "para_missing_break":
        rel = (
            f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY pos) AS rn FROM "
            f"({spans('SELECT * FROM p', keys, 'text', fx.MISSING_BREAK)}) QUALIFY rn = 1"
        )
    elif key in ("para_stop_no_space", "para_stop_space"):
        pattern = fx.STOP_SPACE if key == "para_stop_space" else fx.STOP_NO_SPACE
        rel = spans(f"SELECT {keys}, {edited()} AS text FROM p", keys, "text", pattern)
        if key == "para_stop_space":
            w1, w2 = (f"regexp_extract(item, {q(pattern)}, {g})" for g in (1, 2))
            pairs = " OR ".join(f"(w1 = {q(a)} AND w2 = {q(b)})" for a, b in fx.STOP_WORD_PAIRS)
            titles = ", ".join(q(t) for t in fx.STOP_TITLES)
            rel = (
                f"SELECT * FROM (SELECT *, {w1} AS w1, {w2} AS w2 FROM ({rel})) WHERE NOT (w1 IN ({titles}) "
                f"OR {has('w2', fx.NUMERALS_ANY_CASE)} OR w2 = {q(fx.STOP_SECOND_WORD)} OR {pairs})"
            )
    else:
        pattern = {
            "para_he_be": fx.PARA_HE_BE,
            "para_had_bad": fx.PARA_HAD_BAD,
            "para_hut_but": fx.PARA_HUT_BUT,
        }[key]
        found = spans(f"SELECT {keys}, lower(text) AS low FROM p", keys, "low", pattern).replace(
            "low AS text", "low AS lowered"
        )
        rel = f"SELECT s.doc_id, s.para_no, s.item, s.pos, p.text FROM ({found}) s JOIN p USING (doc_id, para_no)"
    return base + with_context(rel, keep)


def repeated_words(seeds=None) -> str:
    marked = rf"regexp_replace(text, '(\p{{L}}+)', {q(chr(1) + chr(92) + '1' + chr(2))}, 'g')"
    rel = f"""
SELECT doc_id, para_no, text, word, p0 + length(word) AS pos FROM (
  SELECT *, lead(word) OVER o AS next_word FROM (
    SELECT *, split_part(piece, chr(2), 1) AS word, split_part(piece, chr(2), 2) AS sep,
      sum(length(replace(piece, chr(2), ''))) OVER (PARTITION BY doc_id, para_no ORDER BY k
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p0
    FROM (SELECT doc_id, para_no, text, unnest(ps) AS piece, unnest(range(1, len(ps) + 1)) AS k
      FROM (SELECT *, string_split({marked}, chr(1)) AS ps FROM p))) WHERE k > 1
  WINDOW o AS (PARTITION BY doc_id, para_no ORDER BY k))
WHERE word = next_word AND sep = ' ' AND length(word) > 1"""
    return ctes(src(seeds), LINES, PARAS) + with_context(rel, "doc_id, para_no, word", at="pos::BIGINT")


# ------------------------------------------------------------- word lists etc.

BENCH = f"""
bw AS MATERIALIZED (SELECT unnest({spell_words_sql("regexp_replace(text, '[\r\n]+', ' ', 'g')")}) AS word FROM benchmark)"""
_DECLARED = f"""
gl AS (SELECT unnest([{", ".join(q(w) for w in C.GOOD_WORDS)}]) AS word),"""
_ALL_LISTED = f"""
gl AS (SELECT unnest([{", ".join(q(w) for w in C.GOOD_WORDS)}]) AS word UNION ALL SELECT word FROM bw),"""
_GOOD_FORMS = f"""
gq AS (SELECT replace(word, '''', '’') AS word FROM gl),
gw AS MATERIALIZED (SELECT word FROM gq
    UNION SELECT {title_sql("word")} FROM gq WHERE lower(word) = word
    UNION SELECT {upper_sql("word")} FROM gq WHERE lower(word) = word OR {title_sql("word")} = word)"""
GOOD_LIST = _DECLARED + _GOOD_FORMS
SCANNOS = (
    "sl AS (SELECT unnest([" + ", ".join(q(w) for w in fx.COMMON_SCANNOS) + "]) AS word),"
    f"sc AS MATERIALIZED (SELECT word FROM sl UNION SELECT {title_sql('lower(word)')} FROM sl "
    f"UNION SELECT {upper_sql('lower(word)')} FROM sl)"
)
DICTIONARY = f"""
dl AS (SELECT DISTINCT replace(lower(word), '''', '’') AS word FROM bw),
dw AS MATERIALIZED (SELECT word FROM dl UNION SELECT {title_sql("word")} FROM dl UNION SELECT {upper_sql("word")} FROM dl)"""


def word_marked(text: str, word: str) -> str:
    return (
        f"regexp_replace({text}, '(^|\\P{{L}})(' || regexp_escape({word}) || ')(\\P{{L}}|$)', "
        "'\\1⟦\\2⟧\\3', 'g')"
    )


def scannos(good: bool = False, seeds=None) -> str:
    rel = f"SELECT doc_id, word, line_no, {word_marked('text', 'word')} AS text FROM t JOIN sc USING (word)"
    lists = [BENCH, GOOD_LIST] if good else []
    if good:
        rel += " WHERE word NOT IN (SELECT word FROM gw)"
    return ctes(src(seeds), LINES, TOKENS, SCANNOS, *lists) + with_context(
        f"SELECT *, strpos(text, '⟦') - 1 AS pos FROM ({rel})", "doc_id, word, line_no"
    )


def places_of(base: str, words: str, places: str = "b") -> str:
    """First places of ``words(doc_id, word)``; ``places(doc_id, line_no, word)``."""
    base += f""",
ww AS (SELECT DISTINCT doc_id, word FROM ({words})),
wo AS MATERIALIZED (SELECT o.* FROM {places} o JOIN ww USING (doc_id, word)),
cw AS (SELECT doc_id, word, count(*) AS n FROM wo GROUP BY doc_id, word),
cl AS (SELECT DISTINCT doc_id, word, line_no FROM wo),
cr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, word ORDER BY line_no) AS rn FROM cl),
cn AS (SELECT cr.doc_id, cr.word, cr.line_no, greatest(n - 2, 0)::BIGINT AS n_more
    FROM cr JOIN cw USING (doc_id, word) WHERE rn <= 2)"""
    return base


def concordance() -> str:
    base = ctes(src(), LINES, POSTINGS, VOCAB)
    base = places_of(base, f"SELECT doc_id, word FROM v WHERE {has('lower(word)', fx.NUMERALS)}")
    base += f""",
cj AS (SELECT cn.*, {word_marked('l.text', 'cn.word')} AS text
    FROM cn JOIN l ON l.doc_id = cn.doc_id AND l.line_no = cn.line_no)"""
    return base + with_context(
        "SELECT *, strpos(text, '⟦') - 1 AS pos FROM cj", "doc_id, word, line_no, n_more::BIGINT AS n_more"
    )


def suspect_lines(good: bool = False, seeds=None) -> str:
    cut = f""",
sw AS MATERIALIZED (SELECT doc_id, line_no, unnest({spell_words_sql("text")}) AS word FROM l)"""
    return places_of(spelling(cut, good, seeds), "SELECT doc_id, word FROM su", "sw") + " SELECT * FROM cn"


def near_pair_lines(good: bool = False, seeds=None) -> str:
    pairs = f"SELECT doc_id, unnest([suspect, near]) AS word FROM ({edit_distance(good, seeds)})"
    return places_of(ctes(src(seeds), LINES, POSTINGS), pairs) + " SELECT * FROM cn"


def mixed_case(good: bool = True, seeds=C.SITUATIONS) -> str:
    def cond(pats):
        return " AND ".join(has("word", p) for p in pats)

    return (
        ctes(src(seeds), LINES, TOKENS, POSTINGS, VOCAB, BENCH, GOOD_LIST)
        + f""",
m AS (SELECT * FROM t WHERE CASE WHEN starts_with(word, '’') THEN {cond(fx.MIXED_CASE_APOSTROPHE)}
    ELSE {cond(fx.MIXED_CASE)} END)
SELECT m.doc_id, m.word, m.line_no FROM m LEFT JOIN v ON v.doc_id = m.doc_id AND v.word = m.word
WHERE coalesce(v.n, 0) < 2 {"AND NOT EXISTS (SELECT 1 FROM gw WHERE contains(m.word, gw.word))" if good else ""}"""
    )


def odd_words(seeds=C.SITUATIONS) -> str:
    ends = ", ".join(q(e) for e in fx.RARE_ENDINGS)
    starts = ", ".join(q(e) for e in fx.RARE_BEGINNINGS)
    return (
        ctes(src(seeds), LINES, TOKENS)
        + f"""
SELECT doc_id, 'query word ending with ' || right(word, 2) AS rule, line_no, word FROM t
WHERE strlen(word) > 2 AND right(word, 2) IN ({ends})
UNION ALL
SELECT doc_id, 'query word starting with ' || left(word, 2) AS rule, line_no, word FROM t
WHERE strlen(word) > 2 AND left(word, 2) IN ({starts})"""
    )


def hyphen_pairs(seeds=C.TYPESET) -> str:
    return ctes(src(seeds), LINES, POSTINGS, VOCAB) + """,
hp AS (SELECT a.doc_id, b.word AS solid, b.n AS n_solid, a.word AS hyphenated, a.n AS n_hyphenated
    FROM v a JOIN v b ON a.doc_id = b.doc_id AND replace(a.word, '-', '') = b.word
    WHERE contains(a.word, '-') AND NOT regexp_matches(a.word, '[0-9]'))"""


def hyphen_pairs_by_list() -> str:
    """The same pairs from one list of words per document."""
    return ctes(src(C.TYPESET), LINES.replace(" AS MATERIALIZED", " AS NOT MATERIALIZED")) + f""",
ws AS NOT MATERIALIZED (SELECT doc_id, flatten(list({book_words_sql("text")})) AS words FROM l GROUP BY doc_id),
wh AS NOT MATERIALIZED (SELECT doc_id, words, list_distinct(list_filter(words,
    lambda w: contains(w, '-') AND NOT regexp_matches(w, '[0-9]') AND list_contains(words, replace(w, '-', '')))) AS hs FROM ws)
SELECT doc_id, replace(h, '-', '') AS solid, len(list_filter(words, lambda w: w = replace(h, '-', ''))) AS n_solid,
    h AS hyphenated, len(list_filter(words, lambda w: w = h)) AS n_hyphenated
FROM (SELECT doc_id, words, unnest(hs) AS h FROM wh)"""


def ok_words() -> str:
    """Vocabulary without suspects, as one grouping of tagged rows."""
    sql = spelling(
        """SELECT doc_id, word, sum(n)::BIGINT AS n FROM (SELECT doc_id, word, n, 0 AS bad FROM v
    UNION ALL SELECT doc_id, word, 0, 1 FROM su) GROUP BY doc_id, word HAVING max(bad) = 0"""
    )
    return sql.replace(" AS MATERIALIZED", " AS NOT MATERIALIZED")


def hyphen_lines(seeds=C.TYPESET) -> str:
    return hyphen_pairs(seeds) + """,
hs AS (SELECT doc_id, solid AS word FROM hp UNION SELECT doc_id, hyphenated FROM hp)
SELECT doc_id, word, line_no FROM b JOIN hs USING (doc_id, word)
QUALIFY row_number() OVER (PARTITION BY doc_id, word ORDER BY line_no) <= 4"""


def compounds() -> str:
    return f"""
hc AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(lower(text), {q(fx.HYPHEN_COMPOUND)})) AS compound, line_no
    FROM l WHERE contains(text, '-'))"""


def hyphen_space(seeds=C.HYPHENS) -> str:
    return (
        ctes(src(seeds), LINES, compounds())
        + r""",
cd AS (SELECT DISTINCT doc_id, compound, replace(compound, '-', ' ') AS phrase FROM hc),
sp AS (SELECT cd.doc_id, compound, phrase, l.line_no FROM cd JOIN l ON l.doc_id = cd.doc_id
    AND contains(lower(l.text), phrase) AND regexp_matches(l.text, '(?i)\P{L}' || phrase || '\P{L}')),
hit AS (SELECT DISTINCT doc_id, compound, phrase FROM sp)
SELECT doc_id, compound, phrase, 'spaced' AS form, line_no FROM sp
UNION ALL
SELECT hc.doc_id, hc.compound, hit.phrase, 'hyphenated' AS form, line_no FROM hc JOIN hit USING (doc_id, compound)"""
    )


def line_intersection() -> str:
    return (
        ctes(src(C.HYPHENS), LINES, POSTINGS)
        + """,
hw AS (SELECT DISTINCT doc_id, word FROM b WHERE regexp_matches(word, '[^-]-[^-]')),
pt AS (SELECT DISTINCT doc_id, word, unnest(string_split(word, '-')) AS part FROM hw),
nd AS (SELECT doc_id, word, count(*) AS need FROM pt GROUP BY doc_id, word),
dl AS (SELECT DISTINCT doc_id, line_no, word AS part FROM b)
SELECT pt.doc_id, pt.word, dl.line_no FROM pt JOIN dl USING (doc_id, part) JOIN nd ON nd.doc_id = pt.doc_id
    AND nd.word = pt.word GROUP BY pt.doc_id, pt.word, dl.line_no, need HAVING count(*) = need"""
    )


# -------------------------------------------------------------------- he / be


def trained(where: str) -> str:
    def half(form, triple):
        return f"""SELECT '{form}' AS form, unnest(regexp_extract_all(lower(text), {q(triple)})) AS phrase FROM tp"""

    lines_of = LINES.replace("src)", "tsrc)").replace("cut ", "tcut ").replace("FROM cut", "FROM tcut")
    lines_of = lines_of.replace("num ", "tnum ").replace("FROM num", "FROM tnum").replace("l AS", "tl AS")
    paras_of = PARAS.replace("FROM l)", "FROM tl)").replace("isl", "tisl").replace("blk", "tblk")
    paras_of = paras_of.replace("p AS", "tp AS")
    return (
        src(where=where).replace("src AS", "tsrc AS")
        + ","
        + lines_of
        + ","
        + paras_of
        + f""",
hb AS MATERIALIZED (SELECT form, phrase, count(*) AS n FROM (
    {half("be", fx.TRIPLE_BE)} UNION ALL {half("he", fx.TRIPLE_HE)}) GROUP BY form, phrase)"""
    )


def jeebies(form: str, seeds=None) -> str:
    other = "he" if form == "be" else "be"
    triple = fx.TRIPLE_BE if form == "be" else fx.TRIPLE_HE
    limit = "> 1.0" if form == "be" else ">= 1.0"
    base = ctes(src(seeds), LINES, PARAS, trained("TRUE"))
    base += f""",
tr AS (SELECT doc_id, para_no, trim(text, {SPACES}) AS text FROM p),
oc AS (SELECT doc_id, para_no, text, unnest(regexp_extract_all(lower(text), {q(triple)})) AS phrase FROM tr),
sc AS (SELECT oc.*, coalesce(o.n, 0) AS n_own, a.n AS n_other, strpos(lower(text), oc.phrase) - 1 AS pos FROM oc
    JOIN hb a ON a.form = '{other}' AND a.phrase = regexp_replace(oc.phrase, '{form}', '{other}')
    LEFT JOIN hb o ON o.form = '{form}' AND o.phrase = oc.phrase)"""
    rel = f"""SELECT *, CASE WHEN n_own = 0 THEN -1.0::DOUBLE ELSE n_other::DOUBLE / n_own END AS score FROM sc
        WHERE n_other > 0 AND (n_own = 0 OR n_other::DOUBLE / n_own {limit})"""
    return base + with_context(rel, "doc_id, para_no, phrase, n_own, n_other, score")


def hebe_counts() -> str:
    def half(form, begin, end):
        return f"""SELECT doc_id, line_no, text, '{form}' AS form,
            last_value(CASE WHEN text = {q(begin)} THEN 1 WHEN text = {q(end)} THEN 0 END IGNORE NULLS)
            OVER (PARTITION BY doc_id ORDER BY line_no) AS inside FROM l"""

    marks = ", ".join(q(m) for m in (fx.BEGIN_HE, fx.END_HE, fx.BEGIN_BE, fx.END_BE))
    return (
        ctes(src(C.LIST_FILES), LINES)
        + f""",
s AS ({half("he", fx.BEGIN_HE, fx.END_HE)} UNION ALL {half("be", fx.BEGIN_BE, fx.END_BE)}),
r AS (SELECT doc_id, form, line_no, replace(split_part(text, ':', 1), '|', ' ') AS phrase, split_part(text, ':', 2) AS c
    FROM s WHERE inside = 1 AND contains(text, ':') AND text NOT IN ({marks}))
SELECT doc_id, form, phrase,
    arg_max(CASE WHEN regexp_matches(c, '^[+-]?\\d+$') THEN coalesce(try_cast(c AS BIGINT), 0) ELSE 0 END, line_no) AS n
FROM r GROUP BY doc_id, form, phrase"""
    )


# ------------------------------------------------------------------- spelling


def suspects_ctes(good: bool = False) -> str:
    if good:
        body = "replace(regexp_replace(src.text, '^\\x{FEFF}', ''), chr(13) || chr(10), chr(10))"
        cloak = f"""
gd AS (SELECT src.doc_id, list(g.word ORDER BY -length(g.word), g.word) AS gs
    FROM src JOIN gw g ON contains(src.text, g.word) GROUP BY src.doc_id),
ck AS (SELECT src.doc_id, list_reduce(list_prepend({body}, coalesce(gs, [])), lambda a, g: replace(a, g, '▷0◁')) AS c
    FROM src LEFT JOIN gd ON gd.doc_id = src.doc_id),
pc AS (SELECT DISTINCT doc_id, unnest({spell_words_sql("c")}) AS word FROM ck),"""
    else:
        cloak = f"""
pc AS (SELECT DISTINCT doc_id, unnest({spell_words_sql("word")}) AS word FROM v),"""
    tails = ", ".join(q(t) for t in fx.ORDINAL_TAILS)
    return cloak + f"""
un AS (SELECT doc_id, word FROM pc WHERE length(word) > 1 AND word NOT IN ({tails})
    AND NOT EXISTS (SELECT 1 FROM dw WHERE dw.word = pc.word)),
us AS (SELECT un.doc_id, un.word, sum(CASE WHEN v.word IN (un.word, lower(un.word), {upper_sql("un.word")},
        {title_sql("lower(un.word)")}) THEN v.n ELSE 0 END) AS uses
    FROM un LEFT JOIN v ON v.doc_id = un.doc_id AND lower(v.word) = lower(un.word) GROUP BY un.doc_id, un.word),
su AS MATERIALIZED (SELECT doc_id, word FROM us WHERE coalesce(uses, 0) < {fx.COMMON_FROM})"""


def spelling(tail: str, good: bool = False, seeds=None) -> str:
    lists = [BENCH, DICTIONARY] + ([GOOD_LIST] if good else [])
    return ctes(src(seeds), LINES, POSTINGS, VOCAB, *lists, suspects_ctes(good)) + tail


# --------------------------------------------------------------- smart quotes


def quote_ctes(seeds) -> str:
    """Lines with apostrophes masked that need no dictionary, then candidates."""
    m = twice("text", r"(\p{L})’(\p{L})", r"\1▿\2")
    m = f"regexp_replace({m}, {q(fx.APOSTROPHE_AFTER)}, {q(chr(92) + '1' + chr(92) + '2▿' + chr(92) + '3')}, 'g')"
    m = f"regexp_replace({m}, {q(fx.APOSTROPHE_BEFORE)}, {q(chr(92) + '1▿' + chr(92) + '2' + chr(92) + '3')}, 'g')"
    joined = "regexp_extract(acc, '[^\n]*$') || ' ' || x"
    closed = f"regexp_replace({joined}, {q(fx.SINGLE_QUOTED)}, {q('⸢' + chr(92) + '1⸣')}, 'g')"
    last = "length(regexp_extract(acc, '[^\n]*$'))"
    kinds = [("in", fx.ENDS_IN), ("h", fx.STARTS_APOSTROPHE), ("s", fx.ENDS_S)]
    stems = " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, {q(p)}, 2)) AS stem FROM ql"
        for k, p in kinds
    )
    return (
        src(seeds)
        + ","
        + LINES
        + f""",
am AS (SELECT doc_id FROM l GROUP BY doc_id
    HAVING sum(contains(text, '.’')::INT) <= sum(contains(text, '.”')::INT)),
m4 AS (SELECT doc_id, line_no, {m} AS text FROM l JOIN am USING (doc_id)),
aw AS (SELECT doc_id, word FROM (SELECT doc_id, unnest(regexp_extract_all(text, {q(fx.LEADING_APOSTROPHE)}, 2)) AS word
    FROM m4) GROUP BY doc_id, word HAVING count(*) > 1),
ak AS (SELECT doc_id, list(word) AS ks FROM aw GROUP BY doc_id),
m5 AS (SELECT m4.doc_id, line_no, CASE WHEN ks IS NULL THEN text ELSE list_reduce(list_prepend(text, ks),
    lambda acc, k: replace(acc, k, replace(k, '’', '▾'))) END AS text FROM m4 LEFT JOIN ak USING (doc_id)),
m6 AS (SELECT doc_id, list_reduce(list_append(list(text ORDER BY line_no), ''), lambda acc, x:
    left(acc, length(acc) - {last}) || left({closed}, {last}) || chr(10) || substr({closed}, {last} + 2)) AS text
    FROM m5 GROUP BY doc_id),
q1 AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM m6),
q2 AS (SELECT doc_id, a, unnest(range(1, len(a))) AS line_no FROM q1),
ql AS MATERIALIZED (SELECT doc_id, line_no, a[line_no] AS text FROM q2),
st AS (SELECT DISTINCT doc_id, kind, stem, CASE kind WHEN 'in' THEN stem || 'g' WHEN 'h' THEN 'h' || stem ELSE stem END AS word
    FROM ({stems})),"""
        + BENCH
        + ","
        + DICTIONARY
        + """,
ca AS MATERIALIZED (SELECT doc_id, kind, stem, word FROM st WHERE word IN (SELECT word FROM dw))"""
    )


def scan_ctes() -> str:
    """The stack scan as a fold over strings: stack, told marks, tags."""
    acc = {n: f"split_part(acc, chr(1), {i})" for i, n in enumerate(["st", "told", "tags"], 1)}
    mark, top = "substr(x, 1, 1)", f"right({acc['st']}, 1)"
    opens = f"{mark} IN ('“', '‘')"
    fits = f"(({mark} = '”' AND {top} = '“') OR ({mark} = '’' AND {top} = '‘'))"
    again = f"({opens} AND {top} = {mark} AND NOT contains({acc['told']}, {mark}))"
    tag = f"CASE {mark} WHEN '“' THEN 'CODQ' WHEN '‘' THEN 'COSQ' WHEN '”' THEN 'UCDQ' ELSE 'UCSQ' END"
    return f""",
kb AS (SELECT doc_id, list(CASE kind WHEN 'in' THEN stem || '’' WHEN 'h' THEN '’' || stem ELSE stem || 's’' END) AS ks
    FROM ca GROUP BY doc_id),
m9 AS (SELECT ql.doc_id, line_no, CASE WHEN ks IS NULL THEN text ELSE list_reduce(list_prepend(text, ks),
    lambda acc, k: replace(acc, k, replace(k, '’', '▵'))) END AS text FROM ql LEFT JOIN kb USING (doc_id)),
bk AS (SELECT *, trim(text, {SPACES}) = '' AS blank FROM m9),
pg AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM bk),
pl AS (SELECT doc_id, g, max(line_no) AS last_line FROM pg WHERE NOT blank GROUP BY doc_id, g),
ev AS (SELECT doc_id, g, line_no, unnest(cs) AS mark, unnest(range(0, len(cs))) AS pos
    FROM (SELECT *, string_split(text, '') AS cs FROM pg WHERE NOT blank AND regexp_matches(text, '[“”‘’]'))),
fo AS (SELECT doc_id, g, list_reduce(list_prepend(chr(1) || chr(1),
    list(mark || line_no || ',' || pos ORDER BY line_no, pos)), lambda acc, x:
    CASE WHEN {opens} THEN {acc['st']} || {mark} WHEN {fits} THEN left({acc['st']}, length({acc['st']}) - 1)
        ELSE {acc['st']} END || chr(1) || {acc['told']} || CASE WHEN {again} THEN {mark} ELSE '' END || chr(1) ||
    {acc['tags']} || CASE WHEN {again} OR NOT ({opens} OR {fits}) THEN x || ',' || {tag} || ';' ELSE '' END) AS f
    FROM ev WHERE mark IN ('“', '”', '‘', '’') GROUP BY doc_id, g),
tg AS (SELECT doc_id, unnest(string_split(split_part(f, chr(1), 3), ';')) AS x FROM fo),
sq AS MATERIALIZED (
    SELECT doc_id, split_part(substr(x, 2), ',', 1)::BIGINT AS line_no, split_part(x, ',', 2)::BIGINT AS pos,
        split_part(x, ',', 3) AS tag, left(x, 1) AS item FROM tg WHERE x <> ''
    UNION ALL
    SELECT fo.doc_id, last_line, -1, 'NESK', array_to_string(string_split(split_part(f, chr(1), 1), ''), ' ')
    FROM fo JOIN pl ON pl.doc_id = fo.doc_id AND pl.g = fo.g WHERE split_part(f, chr(1), 1) <> '')"""


def overlay() -> str:
    return ctes(quote_ctes(C.QUOTES)) + scan_ctes() + """,
tl AS (SELECT doc_id, line_no, list_sort(list((pos + 1000000)::VARCHAR || ',' || tag || ',' || item), 'DESC') AS ts
    FROM sq GROUP BY doc_id, line_no)
SELECT l.doc_id, l.line_no, CASE WHEN ts IS NULL THEN text ELSE list_reduce(list_prepend(text, ts), lambda acc, t:
    CASE WHEN split_part(t, ',', 2) = 'NESK' THEN acc || '[@NESK ' || split_part(t, ',', 3) || ']'
    ELSE left(acc, split_part(t, ',', 1)::BIGINT - 1000000) || '[@' || split_part(t, ',', 2) || ']' ||
        substr(acc, split_part(t, ',', 1)::BIGINT - 999999) END) END AS text
FROM l LEFT JOIN tl ON tl.doc_id = l.doc_id AND tl.line_no = l.line_no
WHERE l.doc_id IN (SELECT doc_id FROM sq)"""


# -------------------------------------------------------------- edit distance


def edit_distance(good: bool = False, seeds=None) -> str:
    """One edit apart, by equal forms with one letter dropped.

    Same length: the same place dropped from both leaves the same letters.
    Lengths one apart: one place dropped from the longer leaves the shorter.
    """
    s = "lower(word)"
    for old, new in fx.LIGATURES:
        s = f"replace({s}, {q(old)}, {q(new)})"

    def keys(name: str, source: str) -> str:
        return f"""
{name} AS MATERIALIZED (SELECT doc_id, x, k, CASE WHEN k = 0 THEN x ELSE left(x, k - 1) || substr(x, k + 1) END AS d, length(x) AS n
    FROM (SELECT doc_id, x, unnest(range(0, length(x) + 1)) AS k FROM (SELECT DISTINCT doc_id, x FROM {source})))"""

    return spelling(
        f""",
ss AS MATERIALIZED (SELECT v.doc_id, v.word AS suspect, v.n AS n_suspect, lower(v.word) AS s_plain, x FROM
    (SELECT *, {s} AS x FROM v) v JOIN su ON su.doc_id = v.doc_id AND su.word = v.word
    WHERE length(x) >= {fx.NEAR_MIN_LENGTH} OR regexp_replace(x, {q(fx.NEAR_PLAIN)}, '', 'g') <> ''),
tt AS MATERIALIZED (SELECT doc_id, word AS near, n AS n_near, lower(word) AS x FROM v),"""
        + keys("ks", "ss")
        + ","
        + keys("kt", "tt")
        + f""",
nr AS MATERIALIZED (SELECT DISTINCT a.doc_id, a.x AS s, b.x AS t FROM ks a JOIN kt b ON a.doc_id = b.doc_id AND a.d = b.d
    AND ((a.k > 0 AND a.k = b.k AND a.n = b.n) OR (a.k = 0 AND b.k > 0 AND b.n = a.n + 1)
        OR (b.k = 0 AND a.k > 0 AND a.n = b.n + 1))
    WHERE a.x <> b.x AND a.x <> b.x || 's' AND a.x || 's' <> b.x
    AND NOT ({has("a.x", fx.NUMERALS)} AND {has("b.x", fx.NUMERALS)})
    AND replace(a.x, '-', '') <> replace(b.x, '-', '')),
pr AS MATERIALIZED (SELECT ss.doc_id, suspect, n_suspect, s_plain, s, near, n_near, t,
    row_number() OVER (PARTITION BY ss.doc_id ORDER BY s_plain, suspect, near) AS place
    FROM nr JOIN ss ON ss.doc_id = nr.doc_id AND ss.x = nr.s JOIN tt ON tt.doc_id = nr.doc_id AND tt.x = nr.t),
fi AS (SELECT doc_id, word, min(place) AS first FROM (SELECT doc_id, s_plain AS word, place FROM pr
    UNION ALL SELECT doc_id, t, place FROM pr) GROUP BY doc_id, word),
kp AS (SELECT pr.* FROM pr JOIN fi a ON a.doc_id = pr.doc_id AND a.word = s_plain
    JOIN fi b ON b.doc_id = pr.doc_id AND b.word = t
    WHERE s <> s_plain OR NOT (a.first < place AND b.first < place))
SELECT doc_id, suspect, n_suspect, near, n_near FROM kp x WHERE NOT (s <> s_plain AND EXISTS (SELECT 1 FROM kp y
    WHERE y.doc_id = x.doc_id AND y.suspect = x.near AND y.near = x.suspect AND y.place < x.place))""",
        good,
        seeds,
    )


# -------------------------------------------------------------------- summary


def text_check_parts(seeds, good: bool) -> list[tuple[str, str, str]]:
    """``(check, rule expression, SQL)`` of the common text checks."""

    parts = [(c, "rule", line_check(c, seeds)) for c in LINE_CHECKS]
    parts += [
        ("special situations", "rule", odd_words(seeds)),
        ("special situations", "'mixed case within word'", mixed_case(good, seeds)),
        ("scannos", "'scannos'", scannos(good, seeds)),
        ("spacing pattern", "'spacing pattern'", f"SELECT * FROM ({spacing(seeds)}) WHERE suspect = 1"),
        ("headers", "'headers'", headers(seeds)),
        ("duplicate lines", "'duplicate lines'", duplicates(seeds)),
        ("rare characters", "'rare characters'", rare_chars(seeds)),
        ("footnotes", "'footnote'", series(fx.FOOTNOTE_LABEL, anchors=False, seeds=seeds)),
        ("footnotes", "'footnote anchor'", series(fx.FOOTNOTE_ANCHOR, anchors=True, seeds=seeds)),
        ("book level", "rule", book_level(seeds)),
        ("book level", "'repeated line'", repeated_lines(seeds)),
        ("repeated words", "'repeated words'", repeated_words(seeds)),
    ]
    return parts + [("paragraph level", "rule", para_rule(k, seeds)) for k in PARA_KEYS]


def all_parts(seeds) -> list[tuple[str, str, str]]:
    """Every family; the he/be list stays trained on the unmarked documents."""
    tags = ctes(quote_ctes(seeds)) + scan_ctes() + "SELECT * FROM sq"
    return text_check_parts(seeds, good=True) + [
        ("hyphenation", "'solid and hyphenated'", hyphen_pairs(seeds) + "SELECT * FROM hp"),
        ("hyphenation", "'line of solid or hyphenated'", hyphen_lines(seeds)),
        ("hyphenation", "form", hyphen_space(seeds)),
        ("smart quotes", "tag", tags),
        ("spelling", "'suspect word'", spelling("SELECT * FROM su", good=True, seeds=seeds)),
        ("spelling", "'line of suspect word'", suspect_lines(True, seeds)),
        ("edit distance", "'near word'", edit_distance(True, seeds)),
        ("edit distance", "'line of near word'", near_pair_lines(True, seeds)),
        ("he/be", "'query be'", jeebies("be", seeds)),
        ("he/be", "'query he'", jeebies("he", seeds)),
    ]


def summary(parts: list[tuple[str, str, str]]) -> str:
    union = " UNION ALL ".join(
        f"SELECT {q(check)} AS c, r, n FROM (SELECT {rule} AS r, count(*) AS n FROM ({sql}) GROUP BY ALL) WHERE n > 0"
        for check, rule, sql in parts
    )
    return f"""SELECT coalesce(c, 'ALL') AS "check", coalesce(r, 'ALL') AS rule, sum(n)::BIGINT AS n,
    grouping(c, r)::BIGINT AS level FROM ({union}) GROUP BY ROLLUP (c, r)"""


def summary_by_doc(parts: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"""SELECT doc_id, {q(check)} AS "check", {rule} AS rule, count(*) AS n FROM ({sql}) GROUP BY ALL"""
        for check, rule, sql in parts
    )


def repeated_lines(seeds=None) -> str:
    return (
        ctes(src(seeds), LINES, NEAR)
        + f"SELECT doc_id, line_no, text FROM w WHERE text = after AND strlen(text) > {fx.REPEATED_LINE_OVER_BYTES}"
    )


def oracle_sql() -> dict[str, str]:
    out = {
        "doc_lines": ctes(src(), LINES) + "SELECT doc_id, line_no, text FROM l",
        "good_words": ctes(BENCH, _ALL_LISTED + _GOOD_FORMS) + "SELECT word FROM gw",
        "scanno_list": ctes(BENCH)
        + f" SELECT word FROM bw UNION SELECT {title_sql('lower(word)')} FROM bw UNION SELECT {upper_sql('lower(word)')} FROM bw",
        "hebe_counts": hebe_counts(),
        "hebe_train": ctes(trained("TRUE")) + "SELECT form, phrase, n FROM hb",
        "findings_sink": ctes(src(C.TYPESET), LINES, NEAR)
        + f' SELECT check_name AS "check", count(*) AS n FROM ({all_line_hits()}) GROUP BY check_name',
        "doc_paragraphs": ctes(src(C.TYPESET), LINES, PARAS)
        + "SELECT doc_id, para_no, first_line, last_line, text FROM p",
        "trimmed_paras": ctes(src(C.SPACING), LINES, PARAS)
        + f"SELECT doc_id, para_no, trim(text, {SPACES}) AS text, lower(trim(text, {SPACES})) AS lower_text FROM p",
        "line_tokens": ctes(src(C.QUOTES), LINES, TOKENS) + "SELECT doc_id, line_no, word_no, word FROM t",
        "vocab": ctes(src(C.TYPESET), LINES, POSTINGS, VOCAB) + "SELECT doc_id, word, n FROM v",
        "postings": ctes(src(C.TYPESET), LINES, POSTINGS) + "SELECT doc_id, word, line_no FROM b",
        "punc_style": ctes(src(C.QUOTES), LINES)
        + """SELECT doc_id, n_single, n_double, CASE WHEN n_single > n_double THEN 'British' ELSE 'American' END AS punc_style
        FROM (SELECT doc_id, sum(contains(text, '.’')::INT)::BIGINT AS n_single,
            sum(contains(text, '.”')::INT)::BIGINT AS n_double FROM l GROUP BY doc_id)""",
        "char_histogram": ctes(src(), LINES)
        + """SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM l WHERE text <> '')
        GROUP BY doc_id, ch""",
        "line_counts": ctes(src(C.TYPESET), LINES)
        + "SELECT doc_id, text, count(*) AS n FROM l GROUP BY doc_id, text",
        "hyphen_index": ctes(src(C.HYPHENS), LINES, compounds()) + "SELECT doc_id, compound, line_no FROM hc",
        "apostrophe_words": ctes(src(C.QUOTES), LINES)
        + f"""SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id,
        unnest(regexp_extract_all(text, {q(fx.LEADING_APOSTROPHE)}, 2)) AS word FROM l) GROUP BY doc_id, word HAVING count(*) > 1""",
        "context": ctes(src(), LINES)
        + with_context("SELECT *, length(text) // 2 AS pos FROM l", "doc_id, line_no"),
        "concordance": concordance(),
        "limited_report": ctes(src(), LINES, NEAR)
        + f""", h AS (SELECT check_name, doc_id, rule, line_no, n, text FROM ({all_line_hits()})),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, check_name, rule ORDER BY
            CASE WHEN check_name = 'long lines' THEN -n ELSE 0 END, line_no, text) AS "rank",
            count(*) OVER (PARTITION BY doc_id, check_name, rule) AS total,
            CASE WHEN check_name = 'dash check' THEN {fx.REPORT_LIMITS['dash check']} ELSE {fx.REPORT_LIMIT} END AS lim FROM h)
        SELECT doc_id, check_name AS "check", rule, "rank", line_no, greatest(total - lim, 0) AS n_more FROM k WHERE "rank" <= lim""",
        "limited_report_chars": f"""SELECT doc_id, ch AS item, "rank", line_no, greatest(total - 2, 0)::BIGINT AS n_more
            FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ch ORDER BY line_no, text) AS "rank",
                count(*) OVER (PARTITION BY doc_id, ch) AS total FROM ({rare_chars()})) WHERE "rank" <= 2""",
        "overlay_texts": f"""SELECT doc_id, string_agg(text, chr(10) ORDER BY line_no) AS text
            FROM ({overlay()}) GROUP BY doc_id""",
        "numeric_filter": ctes(src(C.SITUATIONS), LINES, POSTINGS, VOCAB)
        + f"SELECT doc_id, word, n FROM v WHERE {has('lower(word)', fx.NUMERALS)}",
        "distinct_keep": ctes(src(), LINES, POSTINGS)
        + "SELECT doc_id, word, min(line_no) AS first_line FROM b GROUP BY doc_id, word",
        "line_intersection": line_intersection(),
        "hyphen_nonhyphen": hyphen_pairs_by_list(),
        "hyphen_nonhyphen_lines": hyphen_lines(),
        "hyphen_space": hyphen_space(),
        "asterisks": line_check("asterisks"),
        "adjacent_spaces": line_check("adjacent spaces", C.TYPESET),
        "trailing_spaces": line_check("trailing spaces", C.SITUATIONS),
        "rare_chars": rare_chars(),
        "spacing_pattern": spacing(),
        "headers": headers(),
        "short_lines": line_check("short lines"),
        "long_lines": line_check("long lines"),
        "repeated_words": repeated_words(),
        "duplicate_lines": duplicates(),
        "ellipsis": line_check("ellipsis", C.TYPESET),
        "dash_check": line_check("dash check", C.DASHES),
        "footnotes": series(fx.FOOTNOTE_LABEL, anchors=False),
        "footnote_anchors": series(fx.FOOTNOTE_ANCHOR, anchors=True),
        "scannos": scannos(),
        "scannos_without_good_words": scannos(good=True),
        "floating_quote": line_check("curly quotes", C.TYPESET, ["floating quote"]),
        "quote_direction": line_check("curly quotes", C.QUOTES, ["quote direction"]),
        "gut_line_rules": line_check("special situations", C.SITUATIONS),
        "gut_line_rules_pages": ctes(src(table="pages", key="page_id", text="html"), LINES, NEAR)
        + f" SELECT doc_id, rule, line_no FROM ({line_hits('special situations')})",
        "gut_odd_words": odd_words(),
        "gut_mixed_case": mixed_case(),
        "book_level": book_level(),
        "book_level_counts": book_counts(),
        "repeated_lines": repeated_lines(),
        "spell_suspects": spelling("SELECT doc_id, word FROM su"),
        "spell_suspects_good_words": spelling("SELECT doc_id, word FROM su", good=True),
        "ok_words": ok_words(),
        "dictionary_candidates": ctes(quote_ctes(C.QUOTES)) + "SELECT doc_id, kind, stem, word FROM ca",
        "smart_quote_scan": ctes(quote_ctes(C.QUOTES)) + scan_ctes() + "SELECT doc_id, line_no, pos, tag, item FROM sq",
        "quote_overlay": overlay(),
        "edit_distance": edit_distance(),
        "suspect_lines": suspect_lines(),
        "near_pair_lines": near_pair_lines(),
        "summary_by_doc": f"""SELECT doc_id, "check", rule, sum(n)::BIGINT AS n
            FROM ({summary_by_doc(text_check_parts(None, good=False))}) GROUP BY ALL""",
        "summary": summary(text_check_parts(None, good=False)),
        "run_checks": summary(all_parts(C.TYPESET)),
        "jeebies_be": jeebies("be"),
        "jeebies_he": jeebies("he"),
    }
    for key in PARA_KEYS:
        out[key] = para_rule(key)
    return out
