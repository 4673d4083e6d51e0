"""Column expressions over text: whitespace, names, dates, tokens, labels.

Every helper takes and returns a ``Column``; none of them calls Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from decretum.functions import patterns as P
from decretum.functions.patterns import rx

WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
TOKEN = r"([a-z0-9]+)"


def extract(text: Column, pattern: str, group: int = 0) -> Column:
    """First match of a case-insensitive pattern, or '' when there is none."""
    return F.regexp_extract(text, rx(pattern), group)


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(rx(pattern)), F.lit(group))


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(rx(pattern))


def substitute(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, rx(pattern), replacement)


def let(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is computed once however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def find(haystack: Column, needle: Column) -> Column:
    """Zero-based offset of ``needle``; -1 when absent."""
    return F.call_function("locate", needle, haystack) - 1


def null_if_blank(text: Column) -> Column:
    return F.when(text != "", text)


def strip_chars(text: Column, chars: str) -> Column:
    """Remove any of ``chars`` from both ends."""
    return F.btrim(text, F.lit(chars))


def collapse_ws(text: Column) -> Column:
    """Runs of whitespace become one blank; both ends are stripped."""
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def strip_ws(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def clean_line(line: Column) -> Column:
    """Collapsed line without blanks and full stops at its ends."""
    return strip_chars(F.regexp_replace(line, WHITESPACE, " "), " .")


def split_lines(text: Column) -> Column:
    """Lines of a text; a final line break does not add an empty line."""

    def without_final_blank(parts: Column) -> Column:
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)

    return let(F.split(text, LINE_BREAK, -1), without_final_blank)


def ordered_distinct(items: Column) -> Column:
    """Distinct items in first-seen order."""
    return F.array_distinct(items)


def lookup(table: dict, key: Column) -> Column:
    """Value of a fixed table for ``key``; null when absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


# ---- letter case and names -----------------------------------------------------------


def capitalize(word: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(word.substr(F.lit(2), F.length(word))))


def capitalize_words(text: Column) -> Column:
    return F.array_join(F.transform(F.split(collapse_ws(text), " "), capitalize), " ")


def title_case(text: Column) -> Column:
    """Every run of letters starts upper and goes on lower, as in ``(Civil) No``."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(0))
    return F.array_join(F.transform(runs, capitalize), "")


def title_keeping_initials(text: Column) -> Column:
    """Capitalised words, except dotted tokens, which go upper as a whole."""
    words = F.split(collapse_ws(text), " ")
    return F.array_join(
        F.transform(words, lambda w: F.when(w.contains("."), F.upper(w)).otherwise(capitalize(w))), " "
    )


def person_name(text: Column) -> Column:
    """Name without honorifics and odd characters, in title case."""
    letters = F.regexp_replace(text, r"[^A-Za-z .'-]+", " ")
    bare = strip_chars(F.regexp_replace(substitute(letters, P.JUDGE_TITLES, " "), WHITESPACE, " "), " .")
    return title_keeping_initials(bare)


def person_name_key(text: Column) -> Column:
    """Comparison key of a name: titles and everything but letters and digits removed."""
    bare = F.replace(F.replace(F.lower(text), F.lit("chief justice"), F.lit("")), F.lit("justice"), F.lit(""))
    return F.regexp_replace(bare, r"[^a-z0-9]+", "")


def humanize_label(name: Column) -> Column:
    return title_case(F.trim(F.replace(name, F.lit("_"), F.lit(" "))))


# ---- dates and timelines -------------------------------------------------------------


def date_from_parts(day: Column, month: Column, year: Column) -> Column:
    """Date from text parts; the month may be a number, a name or an abbreviation."""
    number = F.coalesce(month.try_cast("int"), lookup(P.MONTH_NUMBERS, F.lower(month)))
    text = F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.when(number.isNotNull() & (year != "0000"), F.try_to_date(text, "yyyy-MM-dd"))


def normalise_text(text: Column) -> Column:
    """Lower, stripped, double blanks halved once; null counts as ''."""
    return F.replace(strip_ws(F.lower(F.coalesce(text, F.lit("")))), F.lit("  "), F.lit(" "))


def normalise_date(text: Column) -> Column:
    """ISO form of the four accepted notations, else the lower text; null when empty."""

    def of(stripped: Column) -> Column:
        def part(pattern: str, group: int) -> Column:
            return F.regexp_extract(stripped, pattern, group)

        full_month = F.length(part(r"([A-Za-z]+)", 1)) > 3
        may = F.lower(part(r"([A-Za-z]+)", 1)) == "may"
        named = (full_month | may) & (F.lower(part(r"([A-Za-z]+)", 1)) != "sept")
        parsed = (
            F.when(
                stripped.rlike(r"^(\d{4})-(\d{1,2})-(\d{1,2})$"),
                date_from_parts(part(r"^(\d{4})-(\d{1,2})-(\d{1,2})$", 3), part(r"^(\d{4})-(\d{1,2})-(\d{1,2})$", 2),
                                part(r"^(\d{4})-(\d{1,2})-(\d{1,2})$", 1)),
            )
            .when(
                stripped.rlike(r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})$") & named,
                date_from_parts(part(r"^(\d{1,2})\s", 1), part(r"([A-Za-z]+)", 1), part(r"(\d{4})$", 1)),
            )
            .when(
                stripped.rlike(r"^(\d{1,2})-(\d{1,2})-(\d{4})$"),
                date_from_parts(part(r"^(\d{1,2})-(\d{1,2})-", 1), part(r"^(\d{1,2})-(\d{1,2})-", 2), part(r"(\d{4})$", 1)),
            )
            .when(
                stripped.rlike(r"^([A-Za-z]+)\s+(\d{1,2}),\s*(\d{4})$") & named,
                date_from_parts(part(r"\s(\d{1,2}),", 1), part(r"([A-Za-z]+)", 1), part(r"(\d{4})$", 1)),
            )
        )
        return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), F.lower(stripped))

    # the text is stripped once, and its forms are tried one after the other
    return F.when(text != "", let(strip_ws(text), of))


def timeline_text(text: Column) -> Column:
    """The ``within N days/weeks/months`` phrase, null when there is none."""
    return null_if_blank(extract(text, P.TIMELINE, 0))


def timeline_days(text: Column) -> Column:
    """Length of the phrase in days; a month counts 30."""
    amount = F.lower(extract(text, P.TIMELINE, 1))
    unit = F.lower(extract(text, P.TIMELINE, 2))
    number = F.coalesce(lookup(P.NUMBER_WORDS, amount), amount.try_cast("int"))
    factor = F.when(unit.startswith("day"), 1).when(unit.startswith("week"), 7).when(unit.startswith("month"), 30)
    return number * factor


def due_date(text: Column, start: Column) -> Column:
    days = timeline_days(text)
    return F.when(days.isNotNull() & start.isNotNull(), F.date_add(start, days))


# ---- tokens --------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    """Lower alphanumeric tokens in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def token_set(text: Column) -> Column:
    """Distinct tokens without stop words."""
    stop = F.array(*[F.lit(w) for w in P.STOP_WORDS])
    return F.array_except(F.array_distinct(tokens(text)), stop)


def token_overlap(query: Column, text: Column) -> Column:
    """Share of the query's token set found in the text; 0 for an empty query."""
    q = token_set(query)
    shared = F.size(F.array_intersect(q, token_set(text)))
    return F.when(F.size(q) > 0, shared / F.size(q)).otherwise(F.lit(0.0))


# ---- entities ------------------------------------------------------------------------


def clean_party(text: Column) -> Column:
    one = F.regexp_replace(text, WHITESPACE, " ")
    one = substitute(one, P.PARTY_ROLE_SUFFIX, "")
    one = F.regexp_replace(one, r"[^A-Za-z0-9)]+$", "")
    return strip_chars(one, " .:-\n\t")


def split_parties(text: Column) -> Column:
    """Cleaned names of a party line; fragments of one or two letters and 'ors' dropped."""
    bare = substitute(text, r"…\s*(?:Petitioner|Respondent)\(s\)", "")
    names = F.transform(F.split(bare, rx(P.PARTY_SPLIT), -1), clean_party)
    return F.filter(names, lambda n: (F.length(n) > 2) & ~F.lower(n).isin("ors", "or", "others"))


def clean_entity(text: Column) -> Column:
    return substitute(strip_chars(F.regexp_replace(text, WHITESPACE, " "), " .,:;-"), r"^(?:the|said)\s+", "")


def clean_department(text: Column) -> Column:
    """Name of a public entity as written on a page; '' when nothing is left."""
    return let(substitute(clean_party(text), r"^(?:of|by|and|the|said)\s+", ""), _department_name)


def _department_name(value: Column) -> Column:
    court = extract(value, r"\bHigh\s+Court\s+of\s+[^).,;:]+", 0)
    court_name = strip_chars(F.get(F.split(court, rx(P.PLACE_STOP), 2), F.lit(0)), " .,:;-")
    place = capitalize_words(substitute(court_name, r"^High\s+Court\s+of\s+", ""))
    other = substitute(strip_chars(substitute(value, P.DEPARTMENT_TAIL, ""), " .,:;-"), P.TRAILING_LINK, "")
    return (
        F.when(court != "", F.when(place != "", F.concat(F.lit("High Court of "), place)).otherwise(""))
        .when(matches(value, r"\bGovernment\s+of\s+India\b"), "Government of India")
        .otherwise(other)
    )


def high_court_name(text: Column) -> Column:
    """A named High Court with its place capitalised; '' when nothing is left."""
    bare = clean_entity(text)
    bare = strip_chars(F.get(F.split(bare, rx(P.PLACE_STOP + r"|[).,;:]"), 2), F.lit(0)), " .,:;-")
    after = F.regexp_extract(bare, rx(r"^High\s+Court\s+of\s+(.+)$"), 1)
    before = F.regexp_extract(bare, rx(r"^(.+?)\s+High\s+Court$"), 1)
    return (
        F.when(after != "", F.concat(F.lit("High Court of "), capitalize_words(after)))
        .when(before != "", F.concat(capitalize_words(before), F.lit(" High Court")))
        .otherwise(bare)
    )


def clean_owner(text: Column) -> Column:
    """Owner phrase of a direction; null when it is not a possible owner."""
    value = F.regexp_replace(strip_chars(text, " .,:;-"), WHITESPACE, " ")
    value = substitute(value, r"^(?:that\s+)?the\s+", "")

    def accepted(v: Column) -> Column:
        return F.when((v != "") & (F.length(v) <= 120) & ~F.lower(v).isin(*P.NOT_AN_OWNER), v)

    return let(value, accepted)


def clean_action(text: Column) -> Column:
    """Task part of a direction without its deadline phrase."""
    value = strip_ws(substitute(strip_chars(text, " ."), r"\bwithin\s+[^.]+$", ""))
    return F.when(value == "", "Review judgment direction").otherwise(
        F.concat(F.upper(F.substring(value, 1, 1)), value.substr(F.lit(2), F.length(value)))
    )


def looks_public(text: Column) -> Column:
    flat = collapse_ws(F.coalesce(text, F.lit("")))
    return (flat != "") & ~matches(flat, P.NOT_PUBLIC_ENTITY) & matches(flat, P.PUBLIC_ENTITY)


def looks_like_advocate(text: Column) -> Column:
    return matches(F.coalesce(text, F.lit("")), P.ADVOCATE_LIKE)


def name_match_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?U)\W+", ""))


def names_compatible(left: Column, right: Column) -> Column:
    """One key contains the other, and the shorter is long enough to mean it."""
    shorter = F.least(F.length(left), F.length(right))
    longer = F.greatest(F.length(left), F.length(right))
    nested = left.contains(right) | right.contains(left)
    ok = (left != "") & (right != "") & nested & ((shorter >= 12) | (shorter / F.greatest(longer, F.lit(1)) >= 0.55))
    return F.coalesce(ok, F.lit(False))


def roles_consistent(roles: Column, parties: Column) -> Column:
    """Every name in a role fits some party; true where either list is empty."""
    keys = F.transform(parties, name_match_key)

    def fits(role: Column) -> Column:
        return F.exists(keys, lambda party: names_compatible(name_match_key(role), party))

    return (F.size(roles) == 0) | (F.size(parties) == 0) | F.forall(roles, fits)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


# ---- calibration and labels ----------------------------------------------------------


def round_half_even(value: Column, digits: int) -> Column:
    """Rounding of ties to the even neighbour."""
    return F.bround(value, digits)


def calibrated_confidence(score: Column, empty: Column, has_evidence: Column, has_owner: Column) -> Column:
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score.cast("double"), F.lit(0.0))))
    capped = F.when(~has_evidence, F.least(base, F.lit(0.5))).otherwise(base)
    capped = F.when(~has_owner, F.least(capped, F.lit(0.65))).otherwise(capped)
    return F.when(empty, F.least(base, F.lit(0.3))).otherwise(round_half_even(capped, 2))


def normalise_category(value: Column) -> Column:
    raw = F.translate(F.lower(strip_ws(F.coalesce(value, F.lit("")))), "- ", "__")
    return F.coalesce(lookup(P.CATEGORY_ALIASES, raw), null_if_blank(raw), F.lit("legal_review"))


def normalise_priority(value: Column) -> Column:
    raw = F.lower(strip_ws(F.coalesce(null_if_blank(value), F.lit("medium"))))
    return F.when(raw.isin("low", "medium", "high"), raw).otherwise("medium")


def normalise_flag(value: Column, chars: int | None = None) -> Column:
    """One risk flag mapped to its bucket, else its slug, of ``chars`` characters at most where given; '' when nothing is left."""
    low = F.lower(strip_ws(F.coalesce(value, F.lit(""))))

    def has(*words: str) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        return hit

    slug = strip_chars(F.regexp_replace(low, r"[^a-z0-9]+", "_"), "_")
    return (
        F.when(low == "", "")
        .when(low == "timeline_not_specified", low)
        .when(has("owner", "department", "authority"), "owner_unclear")
        .when(has("timeline", "deadline", "date"), "missing_timeline")
        .when(has("condition", "if filed", "if any"), "conditional_follow_up")
        .when(has("evidence", "source"), "source_review_required")
        .otherwise(slug if chars is None else F.substring(slug, 1, chars))
    )


def normalise_flags(values: Column, chars: int | None = None) -> Column:
    return ordered_distinct(F.filter(F.transform(values, lambda v: normalise_flag(v, chars)), lambda f: f != ""))


def is_empty_text(value: Column) -> Column:
    """Null, blank or a word that stands for nothing."""
    flat = F.lower(strip_ws(value))
    return value.isNull() | (flat == "") | flat.isin(*P.EMPTY_WORDS)


def needs_research(value: Column, confidence: Column, threshold: float = 0.5) -> Column:
    flat = F.lower(strip_ws(value))
    return (
        (F.coalesce(confidence, F.lit(0.0)) < threshold)
        | value.isNull()
        | flat.isin("", "unknown", "not mentioned", "none")
    )
