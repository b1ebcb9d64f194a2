"""Word lists, patterns and limits that define the checks.

Nothing here is computed.  Patterns are in the RE2 dialect; pass them through
``re2`` before handing them to Spark.
"""

# ---------------------------------------------------------------- FIXED VALUES
# Commonly mis-scanned words, one per entry, in list order.
COMMON_SCANNOS = """
11 ail arc arid bad bade ball band bar bat bead beads bear bis bit bo boon
borne bow bumbled car carnage carne cast cat cheek clay coining com comer die
docs ease fail fee fie hack haying hi ho hut lie lime loth modem Ms ray ringer
ringers rioted tho tie tier tight tile tiling tinder tip tom tor tram tune wen
yon
""".split()

# Line layout.
SHORT_LINE_MAX = 55
LONG_LINE_OVER = 72
THOUGHT_BREAK = "       *       *       *       *       *"
CHAPTER_GAP = 4
HEADER_MAX = 80
HEADER_CUT = 75
HEADER_MORE = "[...]"

# Characters never reported as rare, and the count from which none is rare.
USUAL_CHARS = (
    ",:;—?!-_0123456789“‘’”. "
    "abcdefghijklmnopqrstuvwxyz"
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)
RARE_BELOW = 10

# Context snippets: characters on each side, and the width used at an edge.
CONTEXT_SIDE = 30
CONTEXT_WIDTH = 60

# Ellipsis faults; any one is a hit.
ELLIPSIS = [
    r"\p{L}\.\.\.[\s\p{L}]",
    r"\p{L}\.\.\.\.\p{L}",
    r"[\s\p{L}]\.\.[\s\p{L}]",
    r"[\s\p{L}]\.\.\.\.\.+[\s\p{L}]",
    r"^\.",
    r"[^\.]\.\.\.$",
    r"\.\s\.+",
    r"(^|[^\.])\.\.($|[^\.])",
]

# Quotes standing alone, and quotes pointing the wrong way.
FLOATING_QUOTE = [r" [“”] ", r"^[“”] ", r" [“”]$"]
QUOTE_DIRECTION = [r"[\.,;!?]+[‘“]", r"[A-Za-z]+[‘“]", r"”[A-Za-z]"]

# Legal dash uses, rewritten or removed in this order before classing a line.
DASH_LEGAL = [
    (r"_", "a"),
    (r"\s——\s", " "),
    (r"([^—])——([^—])", "—"),  # keeps both neighbours
    (r"\p{L}(-\p{L})+", ""),
    (r"\p{L}(\x{2010}\p{L})+", ""),
    (r"-{8,}", ""),
    (r"\p{L}(\x{2011}\p{L})+", ""),
    (r"\p{Nd}\x{2012}\p{Nd}", ""),
    (r"\p{Nd}–\p{Nd}", ""),
    (r"\p{Nd}\s–\s\p{Nd}", ""),
    (r"\p{L}—\p{L}", ""),
    (r"[\p{Ll}I]—\p{Pf}", ""),
    (r"\p{Ll}— \p{Lu}", ""),
]
DASH_LINE_END = r"—$"
# Class of a line by the first dash found in it; adjacent dashes come first.
DASH_ADJACENT = r"\p{Pd}\p{Pd}+"
DASH_ANY = r"\p{Pd}"
DASH_CLASSES = [
    ("hyphen-minus", "-"),
    ("hyphen", "\u2010"),
    ("non-breaking hyphen", "\u2011"),
    ("figure dash", "\u2012"),
    ("en-dash", "\u2013"),
    ("em-dash", "\u2014"),
]

# Footnotes: a label that starts a line, and a bracketed number anywhere.
FOOTNOTE_LABEL = r"^\s*(?:\[|\[?Footnote\s+)(\d+)(?:\]|:)"
FOOTNOTE_ANCHOR = r"\[(\d+)\]"

# Special situations on one line: (rule, patterns any of which is a hit,
# patterns which excuse the line).
SPECIAL_LINE_RULES = [
    (
        "mixed letters and numbers in word",
        [r"(\p{L}\p{Nd})|(\p{Nd}\p{L})"],
        [
            r"(^|\P{L})\p{Nd}*[02-9]?1st(\P{L}|$)",
            r"(^|\P{L})\p{Nd}*[02-9]?2nd(\P{L}|$)",
            r"(^|\P{L})\p{Nd}*[02-9]?3rd(\P{L}|$)",
            r"(^|\P{L})\p{Nd}*[4567890]th(\P{L}|$)",
            r"(^|\P{L})\p{Nd}*1\p{Nd}th(\P{L}|$)",
            r"(^|\P{L})\p{Nd}*[23]d(\P{L}|$)",
        ],
    ),
    ("opening square bracket followed by other than I, G, M, S or number", [r"\[[^IGMS\d]"], []),
    ("punctuation after 'the'", [r"(?i)\bthe[\.\,\?\'\"\;\:\!\@\#\$\^\&\(\)]"], []),
    ("punctuation error", [r"(,\.)|(\.,)|(,,)|([^\.]\.\.[^\.])"], []),
    ("single character line", [r"^.$"], []),
    ("broken hyphenation", [r"(\p{L}\- \p{L})|(\p{L} \-\p{L})"], []),
    ("comma spacing", [r"[a-zA-Z_],[a-zA-Z_]", r"[a-zA-Z_],\d", r"\s,", r"^,"], []),
    ("date format", [r",1\d\d\d"], []),
    ("I/! check", [r"I”"], []),
    ("disjointed contraction", [r"\s’(m|ve|ll|t)\b"], []),
    ("title abbreviation comma", [r"Mr,|Mrs,|Dr,"], []),
    ("spaced punctuation", [r"\s[\?!:;]"], []),
    ("abandoned HTML tag", [r"<\/?.*?>"], []),
    (
        "quote error (context)",
        [r"([\.,;!?’‘]+[‘“])|([A-Za-z]+[“])|([A-LN-Za-z]+[‘])|(“ )|( ”)|(‘s\s)"],
        [],
    ),
    ("standalone 0", [r"\b0\b"], []),
    (
        "standalone 1",
        [r"(^|\P{Nd})1($|\P{Nd})"],
        [
            r"\$1\b",
            r"1,",
            r"1(-|‑|‒|–|—|―)\p{Nd}",
            r"\p{Nd}(-|‑|‒|–|—|―)1",
            r"(^|\P{Nd})1\.",
            r"1st",
        ],
    ),
    ("trailing space on line", [r"\s$"], []),
    ("abbreviation &c without period", [r"&c([^\.]|$)"], []),
    ("line starts with suspect punctuation", [r"^[!;:,.?]"], []),
    ("line that starts with hyphen and then non-hyphen", [r"^-[^-]"], []),
]
# Special situations found by plain substrings, any of which is a hit.
SPECIAL_SUBSTRING_RULES = [
    ("Blank Page placeholder found", ["Blank Page"]),
    ("mixed hyphen/dash", ["—-", "-—"]),
    ("non-breaking space", ["\u00a0"]),
    ("soft hyphen", ["\u00ad"]),
    ("tab character", ["\u0009"]),
    ("ampersand character", ["&"]),
]
# Special situations on the lower-cased line: words a comma or a period
# should not follow.
NO_COMMA_AFTER = (
    "the it's their an mrs a our that's its whose every i'll your my mr mrs "
    "mss mssrs ft pm st dr rd pp cf jr sr vs lb lbs ltd i'm during let toward "
    "among"
).split()
NO_PERIOD_AFTER = (
    "every i'm during that's their your our my or and but as if the its it's "
    "until than whether i'll whose who because when let till very an among "
    "those into whom having thence"
).split()
# Rare word endings and beginnings.
RARE_ENDINGS = "cb gb pb sb tb wh fr br qu tw gl fl sw gr sl cl iy".split()
RARE_BEGINNINGS = "hr hl cb sb tb wb tl tn rn lt tj".split()
# Mixed case inside a word; the second pair is for words opening with ’.
MIXED_CASE = [r"..*?[a-z].*?", r"..*?[A-Z].*?"]
MIXED_CASE_APOSTROPHE = [r"...*?[a-z].*?", r"...*?[A-Z].*?"]

# Spellings counted over a whole document: (name, pattern).
SPELLING_COUNTS = [
    ("a.m.", r"(?i)a\.m\."),
    ("a. m.", r"(?i)a\.\s+m\."),
    ("p.m.", r"(?i)p\.m\."),
    ("p. m.", r"(?i)p\.\s+m\."),
    ("today", r"(?i)today"),
    ("to-day", r"(?i)to-day"),
    ("tonight", r"(?i)tonight"),
    ("to-night", r"(?i)to-night"),
    ("tomorrow", r"(?i)tomorrow"),
    ("to-morrow", r"(?i)to-morrow"),
    ("northeast", r"(?i)northeast"),
    ("north-east", r"(?i)north-east"),
    ("northwest", r"(?i)northwest"),
    ("north-west", r"(?i)north-west"),
    ("southeast", r"(?i)southeast"),
    ("south-east", r"(?i)south-east"),
    ("southwest", r"(?i)southwest"),
    ("south-west", r"(?i)south-west"),
    ("Mr.", r"(?i)\P{L}Mr\."),
    ("Mr", r"(?i)\P{L}Mr\p{Zs}"),
    ("Mrs.", r"(?i)\P{L}Mrs\."),
    ("Mrs", r"(?i)\P{L}Mrs\p{Zs}"),
    ("Dr.", r"(?i)\P{L}Dr\."),
    ("Dr", r"(?i)\P{L}Dr\p{Zs}"),
]
# Pairs of which a document should use one only.
SPELLING_PAIRS = [
    ("a.m.", "a. m."),
    ("p.m.", "p. m."),
    ("today", "to-day"),
    ("tonight", "to-night"),
    ("tomorrow", "to-morrow"),
]
TITLE_PAIRS = [("Mr.", "Mr"), ("Mrs.", "Mrs"), ("Dr.", "Dr")]
COMPASS_SOLID = ["northeast", "northwest", "southeast", "southwest"]
COMPASS_HYPHENED = ["north-east", "north-west", "south-east", "south-west"]
REPEATED_LINE_OVER_BYTES = 5

# Paragraph rules.
STARTS_UPPER = r"^[“”]?[A-Z][A-Z].*?[a-z]"
INITIALS_GROUP = r"(^|\P{L})(\p{Lu}\.)(\p{Lu}\.)+(\P{L}|$)"
STOP_ABBREVIATIONS = [
    "a.m.", "Mr.", "Mrs.", "Dr.", "Rev.", "i.e.", "e.g.", "per cent.", "8vo.", "Co.",
]
STOP_NUMBERED = [r"\d+d\.", r"\d+s\."]
STOP_NO_SPACE = r"(\p{L}+)\.[”’]?(\p{L}+)"
STOP_SPACE = r"(\p{Ll}+)\.[”’]?\s+(\p{Ll}+)"
STOP_TITLES = ["Mr", "Mrs", "Dr"]
STOP_WORD_PAIRS = [("i", "e"), ("ex", "gr"), ("e", "g")]
STOP_SECOND_WORD = "p"
NUMERALS_ANY_CASE = r"^[0-9ivxlcIVXLC]*$"
NUMERALS = r"^[0-9ivxlc]*$"
MISSING_BREAK = r"[\.\?\!]”\s*“"
SPLIT_PARAGRAPH = r"^\s*[a-z]"
PARA_HE_BE = r"\bto he\b|\bis be\b|\bbe is\b|\bwas be\b|\bbe would\b|\bbe could\b"
PARA_HAD_BAD = r"\bi bad\b|\byou bad\b|\bhe bad\b|\bshe bad\b|\bthey bad\b|\ba had\b|\bthe had\b"
PARA_HUT_BUT = r"(, hut\P{L})|(; hut\P{L})"
END_AMERICAN = r"""\.$|:$|\?$|!$|—$|.["”]|\?["”]$|['’]["”]$|!["”]$|—["”]|-----|\]$"""
END_BRITISH = r"""\.$|:$|\?$|!$|—$|.['’]|\?['’]$|["”]['’]$|!['’]$|—['’]|-----|\]$"""

# Words of letters joined by hyphens, two to four parts.
HYPHEN_COMPOUND = r"(?i)(\p{L}+)-(\p{L}+)-?(\p{L}+)?-?(\p{L}+)?"

# Smart quotes: words whose trailing or leading apostrophe is certain.
APOSTROPHE_AFTER = r"(?i)(^|\P{L})(wher|ther|o|an|ha|t)’($|\P{L})"
APOSTROPHE_BEFORE = (
    r"(?i)(^|\P{L})’(way|twas|twill|twould|twere|uns|fore|most|em|ud|cos|cept|ll|less|\d+)($|\P{L})"
)
LEADING_APOSTROPHE = r"(^|\P{L})(’\p{L}+)(\P{L}|$)"
ENDS_IN = r"(^|\P{L})(\p{L}+?in)’(\P{L}|$)"
STARTS_APOSTROPHE = r"(^|\P{L})’(\p{L}+)(\P{L}|$)"
ENDS_S = r"(^|\P{L})(\p{L}+)s’(\P{L}|$)"
SINGLE_QUOTED = r"‘([^’]+)’"

# Spelling.
COMMON_FROM = 5
ORDINAL_TAILS = ["th", "st", "nd"]
# Edit distance: a suspect this long is always compared, a shorter one only
# with a character outside this class; ligatures compare as two characters,
# the second a look-alike of "e".
NEAR_MIN_LENGTH = 5
NEAR_PLAIN = r"[a-zA-Z0-9’]"
LIGATURES = [("æ", "a\U0001d68e"), ("œ", "o\U0001d68e")]

# he/be triples, and the marker lines of a he/be list file.
TRIPLE_BE = r"[a-z’]+ be [a-z’]+"
TRIPLE_HE = r"[a-z’]+ he [a-z’]+"
BEGIN_HE = "*** BEGIN HE ***"
END_HE = "*** END HE ***"
BEGIN_BE = "*** BEGIN BE ***"
END_BE = "*** END BE ***"

# Rows shown per rule before "more": default, and by check.
REPORT_LIMIT = 5
REPORT_LIMITS = {"dash check": 10, "rare characters": 2, "duplicate lines": 4}
REPORT_RULE_LIMITS = {"abandoned HTML tag": 10}
# Checks whose limit holds for each item (each rare character).
REPORT_PER_ITEM = ["rare characters"]
# ------------------------------------------------------------ END FIXED VALUES
