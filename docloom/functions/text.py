"""Text expressions on the JVM side: tokens, word forms, file-name dates, question cues.

Every function takes and returns a Column, so Catalyst sees the whole computation and no Python worker is started.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import settings as S

HEBREW = "\\u0590-\\u05FF"
# Unicode white space, spelled out because the regex engine's default class is ASCII only.
WS = "\\s\\x1c-\\x1f\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
WS_SIGNS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WS_INLINE = WS.replace("\\s", " \\t\\r\\x0b\\f")
WORD = "\\p{L}\\p{N}_"
TOKEN_PATTERN = f"[A-Za-z0-9{HEBREW}]+"
# vowel and cantillation marks of the Hebrew block
MARKS_PATTERN = "[\\u0591-\\u05BD\\u05BF\\u05C1\\u05C2\\u05C4\\u05C5\\u05C7]"
ACRONYM_MARKS = "׳״'\""


def strip_ws(c: Column) -> Column:
    """Without white space at both ends: the signs of WS, one by one, as a regex would try every gap inside a long text."""
    return F.btrim(c, F.lit(WS_SIGNS))


def blank_to_null(c: Column) -> Column:
    s = strip_ws(c)
    return F.when(s != "", s)


def any_contains(c: Column, needles: list[str]) -> Column:
    expr = F.lit(False)
    for n in needles:
        expr = expr | c.contains(n)
    return expr


def any_startswith(c: Column, heads: list[str]) -> Column:
    expr = F.lit(False)
    for h in heads:
        expr = expr | c.startswith(h)
    return expr


def count_of(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences of ``needle``."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


# --- lexical forms ---------------------------------------------------------------------------------------------------

def lexical_tokens(text: Column) -> Column:
    """Tokens after dropping quote marks, so an acronym stays one token."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), ACRONYM_MARKS, ""), F.lit(TOKEN_PATTERN), F.lit(0))


def base_form(token: Column) -> Column:
    """Hebrew: marks removed and final letters folded. Anything else: lower case."""
    folded = F.translate(F.regexp_replace(token, MARKS_PATTERN, ""), S.FINAL_LETTERS, S.MEDIAL_LETTERS)
    return F.when(token.rlike(f"[{HEBREW}]"), folded).otherwise(F.lower(token))


def without_prefix(base: Column) -> Column:
    """One prefix cluster removed (longest first) if a stem of MIN_STEM letters remains, else NULL."""
    rest = f"(?=.{{{S.MIN_STEM}}})"
    alts = "|".join(f"(?:{'|'.join(group)}){rest}" for group in (S.PREFIXES_3, S.PREFIXES_2, S.PREFIXES_1))
    cut = F.regexp_replace(base, f"^(?:{alts})", "")
    return F.when(cut != base, cut)


def _reachable(suffixes: list[str]) -> list[str]:
    """Listed order means first fit; a suffix behind a shorter ending of itself can never be reached."""
    return [s for i, s in enumerate(suffixes) if not any(s.endswith(t) for t in suffixes[:i])]


def without_suffix(base: Column) -> Column:
    """First listed suffix that leaves MIN_STEM letters removed, else NULL. Among reachable suffixes the longest fitting
    one is the first listed, which is the leftmost match of one alternation."""
    cut = F.regexp_replace(base, f"(?<=.{{{S.MIN_STEM}}})(?:{'|'.join(_reachable(S.SUFFIXES))})\\z", "")
    return F.when(cut != base, cut)


def explode_forms(tokens: DataFrame, token_col: str, out: str = "form") -> DataFrame:
    """One row per index form of each token (up to four for Hebrew: base, minus prefix, minus suffix, minus both).

    Built in steps so that each regex runs once per token and only on Hebrew ones."""
    keep = [c for c in tokens.columns if c != token_col]
    hebrew = F.col(token_col).rlike(f"[{HEBREW}]")
    step = tokens.withColumn("_heb", hebrew).withColumn("_base", base_form(F.col(token_col)))
    step = step.withColumn("_pre", F.when(F.col("_heb"), without_prefix(F.col("_base"))))
    step = step.withColumn("_suf", F.when(F.col("_heb"), without_suffix(F.col("_base"))))
    step = step.withColumn("_both", F.when(F.col("_heb") & F.col("_pre").isNotNull(), without_suffix(F.col("_pre"))))
    forms = F.when(F.col("_heb"), F.filter(F.array_distinct(F.array_compact(F.array("_base", "_pre", "_suf", "_both"))),
                                           lambda f: F.length(f) >= 2)).otherwise(F.array("_base"))
    return step.select(*keep, "_base", forms.alias("_forms"))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value built once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def token_forms(tokens: Column) -> Column:
    """All index forms of a list of tokens, with repeats: those that explode_forms makes, without a row for each token."""
    def hebrew(base: Column) -> Column:
        both = lambda pre: F.array(base, pre, without_suffix(base), without_suffix(pre))
        return F.filter(F.array_distinct(F.array_compact(bound(without_prefix(base), both))), lambda f: F.length(f) >= 2)

    is_hebrew = lambda t: t.rlike(f"[{HEBREW}]")
    mixed = F.flatten(F.transform(tokens, lambda t: F.when(is_hebrew(t), bound(base_form(t), hebrew)).otherwise(F.array(F.lower(t)))))
    return F.when(F.exists(tokens, is_hebrew), mixed).otherwise(F.transform(tokens, F.lower))


def counted(values: Column, name: str = "value") -> Column:
    """Distinct values of a list with their counts, in order: array of (``name``, n). Equal values stand together once sorted; the last of each ends
    its run."""
    def runs(s: Column) -> Column:
        last = lambda x, i: F.when(F.coalesce(F.get(s, i + 1) != x, F.lit(True)), F.struct(x.alias(name), (i + 1).alias("end")))
        ends = F.array_compact(F.transform(s, last))
        size = lambda e: F.transform(e, lambda r, i: F.struct(
            r[name].alias(name), (r["end"] - F.coalesce(F.get(e, i - 1)["end"], F.lit(0))).cast("bigint").alias("n")))
        return bound(ends, size)
    return bound(F.sort_array(values), runs)


def title_text(filename: Column) -> Column:
    """File name as searchable words: extension dropped, separators turned into spaces."""
    stem = F.regexp_replace(filename, "\\.[^.]*\\z", "")
    return F.translate(stem, "-_,./\\()[]", " " * 10)


# --- mining tokens -----------------------------------------------------------------------------------------------------

def mining_tokens(text: Column) -> Column:
    """Distinct vocabulary of a text as it is written: runs of 2-40 word characters, leading prefix letters cut, short and stop words dropped."""
    runs = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[{WORD}{HEBREW}]{{2,40}}"), F.lit(0)))
    cut = F.transform(runs, lambda r: F.ltrim(r, F.lit(S.MINING_PREFIX_LETTERS)))
    return F.array_distinct(F.filter(cut, lambda t: (F.length(t) >= 3) & ~F.lower(t).isin(S.MINING_STOP_WORDS)))


# Quoted phrases (three quote styles) and acronyms.
QUOTED_PATTERN = (
    '"([^"\\n]{2,40})"'
    f"|(?<![{HEBREW}])״([^״\\n]{{2,40}})״(?![{HEBREW}])"
    "|«([^»\\n]{2,40})»"
)
ACRONYM_PATTERN = f"[{HEBREW}]{{1,6}}״[{HEBREW}]"


def quoted_and_acronyms(text: Column) -> Column:
    """Quoted phrases (inner text) and acronyms of a text, quoted first."""
    def found(safe: Column) -> Column:
        quoted = F.regexp_extract_all(safe, F.lit(QUOTED_PATTERN), F.lit(0))
        inner = F.transform(quoted, lambda q: strip_ws(q.substr(F.lit(2), F.length(q) - 2)))
        return F.concat(F.filter(inner, lambda q: q != ""), F.regexp_extract_all(safe, F.lit(ACRONYM_PATTERN), F.lit(0)))
    return bound(F.coalesce(text, F.lit("")), found)


# --- decisions ---------------------------------------------------------------------------------------------------------

def decision_type(text: Column) -> Column:
    """'terminal', 'escalation' or NULL, judged on the leading decision only."""
    head = F.regexp_replace(text, f"^[{WS}]+", "")
    verbs = "(?:" + "|".join(S.TRANSFER_VERBS) + ")"
    forums = "(?:" + "|".join(S.HIGHER_FORUM_WORDS) + ")"
    openers = "(?:" + "|".join(S.DECISION_OPENERS) + ")"
    lines = F.split(head, "\n")
    stops = F.transform(F.slice(lines, 2, 1_000_000_000),
                        lambda ln: ln.rlike(f"^[{WS_INLINE}]*(?:\\z|{openers})"))
    stop = F.array_position(stops, F.lit(True))
    leading = F.when(stop > 0, F.array_join(F.slice(lines, F.lit(1), stop.cast("int")), "\n")).otherwise(head)
    escalates = any_contains(leading, S.ESCALATION_PHRASES) | leading.rlike(f"{verbs}[^.\\n]{{0,60}}?{forums}")
    midtext = head.rlike(f"{openers}[{WS}]*:?[{WS}]*[^.\\n]{{0,60}}?{verbs}[^.\\n]{{0,40}}?{forums}")
    return (F.when(any_startswith(head, S.DECISION_OPENERS), F.when(escalates, "escalation").otherwise("terminal"))
            .when(midtext, "escalation"))


def section_ref(section_path: Column) -> Column:
    """Canonical section number; NULL for chapter, decision, procedure and protocol headings."""
    sp = strip_ws(section_path)
    ref = F.regexp_extract(sp, f"^(?:{S.SECTION_WORD}[{WS}]+)?(\\d+(?:\\.(?:\\d+|[א-ת]))*)", 1)
    return F.when(~any_startswith(sp, S.UNNUMBERED_OPENERS) & (ref != ""), ref)


def embedding_input(text: Column, section_path: Column, title: Column) -> Column:
    head = F.concat_ws(" — ", F.when(title != "", strip_ws(title)), F.when(section_path != "", strip_ws(section_path)))
    bare = F.coalesce(title, F.lit("")).eqNullSafe("") & F.coalesce(section_path, F.lit("")).eqNullSafe("")
    return F.when(bare, text).otherwise(F.concat(head, F.lit("\n\n"), text))


# --- dates and statuses ------------------------------------------------------------------------------------------------

def filename_date(filename: Column) -> Column:
    """Date in a file name: ISO first, then day.month.year with two-digit years up to 30 in the 2000s."""
    iso = "(?<!\\d)(\\d{4})-(\\d{1,2})-(\\d{1,2})(?!\\d)"
    dmy = "(?<!\\d)(\\d{1,2})\\.(\\d{1,2})\\.(\\d{2,4})(?!\\d)"

    def build(year: Column, month: Column, day: Column) -> Column:
        text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
        return F.when(year.try_cast("int") >= 1, F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))

    raw = F.regexp_extract(filename, dmy, 3)
    short = raw.try_cast("int")
    year = (F.when(short <= 30, short + 2000).when(short < 100, short + 1900).otherwise(short)).cast("string")
    return F.coalesce(
        build(F.regexp_extract(filename, iso, 1), F.regexp_extract(filename, iso, 2), F.regexp_extract(filename, iso, 3)),
        build(year, F.regexp_extract(filename, dmy, 2), F.regexp_extract(filename, dmy, 1)),
    )


def filename_status(name: Column) -> Column:
    """Lifecycle status told by the start of a file name, else NULL."""
    n = strip_ws(name)
    return (F.when(any_startswith(n, S.STATUS_PREFIXES["proposal"]), "proposal")
            .when(n.substr(1, S.DRAFT_CUE_WINDOW).contains(S.DRAFT_CUE), "draft")
            .when(any_startswith(n, S.STATUS_PREFIXES["discussion"]), "discussion")
            .when(any_startswith(n, S.STATUS_PREFIXES["background"]), "background")
            .when(any_startswith(n, S.STATUS_PREFIXES["invitation"]), "invitation"))


# --- questions ---------------------------------------------------------------------------------------------------------

def intent(question: Column) -> Column:
    q = strip_ws(F.coalesce(question, F.lit("")))
    return (F.when(q.contains(S.SECTION_WORD), "rules")
            .when(any_contains(q, S.META_PATTERNS), "meta")
            .when(any_contains(q, S.SUMMARY_PATTERNS), "summary")
            .otherwise("rules"))


def year_bounds(question: Column) -> tuple[Column, Column]:
    """(from, to) years named in a question; an explicit range wins over loose years."""
    year = "(?<!\\d)(?:19|20)\\d{2}(?!\\d)"
    rng = f"(?:בין[{WS}]+)?({year})[{WS}]*(?:[-–]|עד|ל[-{WS}]?)[{WS}]*({year})"
    a = F.regexp_extract(question, rng, 1).try_cast("int")
    b = F.regexp_extract(question, rng, 2).try_cast("int")
    loose = F.transform(F.regexp_extract_all(question, F.lit(year), F.lit(0)), lambda y: y.cast("int"))
    return (F.coalesce(F.least(a, b), F.array_min(loose)), F.coalesce(F.greatest(a, b), F.array_max(loose)))


def needs_no_triage(question: Column, has_prior: Column, has_terms: Column) -> Column:
    padded = F.concat(F.lit(" "), strip_ws(F.coalesce(question, F.lit(""))), F.lit(" "))
    words = F.size(F.regexp_extract_all(padded, F.lit(f"[^{WS}]+"), F.lit(0)))
    return (~F.coalesce(has_prior, F.lit(False)) & ~F.coalesce(has_terms, F.lit(False))
            & (words >= S.MIN_TRIAGE_SKIP_WORDS) & ~any_contains(padded, S.DEIXIS_MARKERS + S.DISAGREEMENT_MARKERS))


def asks_for_clarification(answer: Column) -> Column:
    return any_contains(F.coalesce(answer, F.lit("")), S.SELF_CLARIFICATION_MARKERS)
