"""Scalar functions over text, dates, names and identifiers: Column -> Column, no Python at run time.

Character classes are spelled out ([А-Яа-яЁёA-Za-z]) because \\w is ASCII in Java's regular expressions.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
#: Single letters of the transliteration; letters of several follow.
SINGLE = ("абвгдезийклмнопрстуфыэ", "abvgdezijklmnoprstufye")
SEVERAL = (("ж", "zh"), ("х", "kh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "shch"), ("ю", "yu"), ("я", "ya"), ("ъ", ""), ("ь", ""))
LOOKALIKES = ("АВЕКМНОРСТХаеорсух", "ABEKMHOPCTXaeopcyx")
#: As LOOKALIKES; in names the small к, м, н and т look alike too.
CONFUSABLE = ("АВЕКМНОРСТХаеорсху", "ABEKMHOPCTXaeopcxy")
SUPERSCRIPTS = ("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&laquo;", "«"), ("&raquo;", "»"), ("&ndash;", "–"), ("&mdash;", "—"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
#: Compatibility letters folded by compare_norm, a part of NFKC: ligatures and full-width digits.
LETTER = "А-Яа-яЁёA-Za-z"


def fold_text(c: Column) -> Column:
    """Lower case, ё as е."""
    return F.translate(F.lower(c), "ё", "е")


def _compared(x: str) -> str:
    """What a comparison keeps of a composed text."""
    return re.sub("[^0-9a-zа-я]", "", x.lower().replace("ё", "е"))


@cache
def compatible() -> tuple[tuple[str, str], dict[str, str]]:
    """Characters whose compatibility form (NFKC) has letters or digits that count in comparisons and that lower case alone doesn't give: those
    that stand for one with these, and spellings of those that stand for several."""
    forms = {chr(i): _compared(unicodedata.normalize("NFKC", chr(i))) for i in range(0x80, 0x20000) if not 0xD800 <= i < 0xE000}
    forms = {x: form for x, form in forms.items() if form and form != _compared(x)}
    single = {x: form for x, form in forms.items() if len(form) == 1}
    return ("".join(single), "".join(single.values())), {x: form for x, form in forms.items() if len(form) > 1}


@cache
def combining() -> str:
    """A pattern of letters that count, each with a combining mark that makes another letter of it, one that doesn't count."""
    letters, marks = "".join(map(chr, (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x410, 0x450)))), map(chr, range(0x300, 0x370))
    made = {m: "".join(x for x in letters if not _compared(unicodedata.normalize("NFC", x + m))) for m in marks}
    return "|".join(f"[{bases}]{m}" for m, bases in made.items() if bases)


#: Characters that have no compatibility form, in ranges as a pattern has them; letters that combining marks change are told by the mark.
USUAL = "\u0000-\u007f\u0400-\u045f\u2010-\u201f«»"


@cache
def usual_letters() -> tuple[str, str]:
    """The usual characters in lower case: those that comparisons keep, and those that they drop."""
    low = dict.fromkeys(chr(i).lower() for i in (*range(0x80), *range(0x400, 0x460), *range(0x2010, 0x2020), 0xAB, 0xBB))
    kept = [x for x in low if _compared(x) == x]
    return "".join(kept), "".join(x for x in low if x != "ё" and _compared(x) != x)


def compare_norm(c: Column) -> Column:
    """For comparing texts: compatibility forms (NFKC), lower case, ё as е, then only digits and Latin and Russian letters.

    A letter and one combining mark right behind it are composed; letters that carry more marks are composed with the first one.
    """
    (single, plain), several = compatible()
    spelled = F.str_to_map(F.lit(",".join(f"{x}:{form}" for x, form in several.items())), F.lit(","), F.lit(":"))
    kept, rest = usual_letters()

    def folded(x: Column) -> Column:
        """Of a text with rare characters: runs of usual ones stay whole, each rare one is looked up."""
        pieces = F.regexp_extract_all(F.translate(x, single, plain), F.lit(f"[{USUAL}]+|(?s)."), F.lit(0))
        spelt = F.array_join(F.transform(pieces, lambda y: F.when(y < "\u0080", y).otherwise(F.coalesce(F.try_element_at(spelled, y), y))), "")
        composed = lambda y: F.regexp_replace(F.replace(F.replace(y, F.lit("и\u0306"), F.lit("й")), F.lit("И\u0306"), F.lit("й")), f"(?=.[\u0300-\u036f])(?:{combining()})", "")
        made = F.get(F.transform(F.array(spelt), lambda y: F.when(y.rlike("[\u0300-\u036f]"), composed(y)).otherwise(y)), F.lit(0))
        return F.regexp_replace(fold_text(made), "[^0-9a-zа-я]+", "")

    def compared(x: Column) -> Column:
        """№ stands in most texts, so it is no reason to look at every character; nor does a text of usual characters cost a regular expression."""
        plainly = F.translate(F.lower(F.replace(x, F.lit("№"), F.lit(several["№"]))), f"ё{rest}", "е")
        return F.get(F.transform(F.array(plainly), lambda y: F.when(F.translate(y, kept, "") == "", y).otherwise(folded(x))), F.lit(0))

    # transform binds c, which would else be computed for every use.
    return F.get(F.transform(F.array(c), compared), F.lit(0))


def name_norm(c: Column) -> Column:
    """Lower case without anything but letters and digits."""
    return F.regexp_replace(F.lower(c), "[^0-9a-zа-яё]", "")


def translit_ru(c: Column) -> Column:
    """Russian to Latin letters, lower case."""
    out = fold_text(c)
    for old, new in SEVERAL:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.translate(out, *SINGLE)


#: Latin letters of ISO 9 for Cyrillic ones, and the spellings of other schemes (BGN, GOST, passports, German) for some of them.
ISO_9 = ("абвгдеёжзийклмнопрстуфхцчшщыэюя", "abvgdeëžzijklmnoprstufhcčšŝyèûâ")
SPELLINGS = {"щ": ("shch", "sch", "šč"), "ж": ("zh",), "х": ("kh",), "ц": ("ts",), "ч": ("ch",), "ш": ("sh",), "ю": ("yu", "ju"), "я": ("ya", "ja"), "ё": ("yo", "jo")}
PLAIN = ("ëžčšŝèûâyj", "ezcsseuaii")  # marks dropped; й and ы are both written y, j or i


def skeleton_steps() -> tuple[list[tuple[str, str]], tuple[str, str]]:
    """Spellings of several letters, long ones first, with the letter that they stand for, and then single letters with theirs: ISO 9 without marks."""
    plain = str.maketrans(*PLAIN)
    iso = dict(zip(ISO_9[0], ISO_9[1].translate(plain)))
    several = sorted(((spelling, iso[letter]) for letter, own in SPELLINGS.items() for spelling in own), key=lambda x: (-len(x[0]), x[0] == "kh"))  # the h of kh must not meet an s
    return several, (ISO_9[0] + PLAIN[0], ISO_9[1].translate(plain) + PLAIN[1])


def translit_skeleton(c: Column) -> Column:
    """A key that a Russian text and its transliterations share, whichever scheme they follow: small Latin letters and digits."""
    several, single = skeleton_steps()
    out = F.lower(c)
    for spelling, letter in several:
        out = F.replace(out, F.lit(spelling), F.lit(letter))
    return F.regexp_replace(F.translate(out, *single), "[^a-z0-9]", "")


def bigrams(c: Column) -> Column:
    """The distinct two-character pieces."""

    def pieces(chars: Column) -> Column:
        at = F.when(F.size(chars) >= 2, F.sequence(F.lit(0), F.size(chars) - 2)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1))))

    # The outer transform binds the characters, which would else be cut for every piece; finding a place in a text would cost all before it.
    return F.get(F.transform(F.array(F.split(c, "")), pieces), F.lit(0))


def bigram_dice(a: Column, b: Column) -> Column:
    """2 |A and B| / (|A| + |B|) of the bigram sets; 0 where both are empty."""
    # transform binds the sets: each would else be made three times, since equal expressions with variables of their own aren't known as equal.
    sets = F.array(F.struct(bigrams(a).alias("x"), bigrams(b).alias("y")))
    return F.get(F.transform(sets, lambda s: dice_of(s["x"], s["y"])), F.lit(0))


def dice_of(x: Column | str, y: Column | str) -> Column:
    """2 |X and Y| / (|X| + |Y|) of two arrays without repeats; 0 where both are empty."""
    size = F.size(x) + F.size(y)
    return F.when(size > 0, 2.0 * F.size(F.array_intersect(x, y)) / size).otherwise(F.lit(0.0))


#: Cyrillic letters without a Latin look-alike.
CYRILLIC_ONLY = "БГДЖЗИЙЛПУФЦЧШЩЪЫЬЭЮЯбвгджзийклмнптфцчшщъыьэюя"


def homoglyph_fix(c: Column) -> Column:
    """Words that mix alphabets: look-alikes become Cyrillic where other Cyrillic letters stand, else Latin."""
    # Whether there is one is all that counts; a text of other alphabets is told by one range, without the list.
    cyrillic = c.rlike("[\u0410-\u044f]") & c.rlike(f"[{CYRILLIC_ONLY}]")
    return F.when(cyrillic, F.translate(c, LOOKALIKES[1], LOOKALIKES[0])).otherwise(F.translate(c, LOOKALIKES[0], LOOKALIKES[1]))


def author_key(c: Column) -> Column:
    """surname_initials: parts of two letters at most are initials (sorted), the first longer one is the surname."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)|[0-9*]", ""), "[.,]", " "))
    parts = F.filter(F.split(plain, r"\s+"), lambda x: x != "")
    surname = F.coalesce(F.get(F.filter(parts, lambda x: F.length(x) > 2), F.lit(0)), F.lit(""))
    initials = F.array_sort(F.transform(F.filter(parts, lambda x: F.length(x) <= 2), lambda x: F.left(x, F.lit(1))))
    return F.concat(surname, F.lit("_"), F.array_join(initials, ""))


def clean_text(c: Column) -> Column:
    """Line ends and separators as line feeds, control characters and word processor fields dropped, blanks squeezed."""
    out = F.regexp_replace(c, "\r\n|\r|\u2028|\u2029", "\n")
    out = F.regexp_replace(out, r"(EMBED|MERGEFORMAT|HYPERLINK)( \"[^\"]*\")?", "")
    out = F.regexp_replace(out, "[\u0000-\u0008\u000b\u000c\u000e-\u001f]", "")
    out = F.regexp_replace(F.regexp_replace(out, "[ \t\u00a0]+", " "), " +([,.;:])", "$1")
    return F.trim(F.regexp_replace(out, " ?\n ?", "\n"))


def strip_html(c: Column) -> Column:
    """br and /p as line feeds, tags dropped, entities decoded, blanks squeezed."""
    out = F.regexp_replace(c, "(?i)<br[^>]*>|</p>", "\n")
    out = F.regexp_replace(out, "<[^>]*>", "")
    for old, new in ENTITIES:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, "[ \t]+", " ")
    return F.trim(F.regexp_replace(out, " ?\n[ \n]*", "\n"))


def escape_html(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("«", "&laquo;"), ("»", "&raquo;"), ("–", "&ndash;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def plural_form(n: Column, one: str, few: str, many: str) -> Column:
    """The Russian form for a number."""
    last, two = F.pmod(n, F.lit(10)), F.pmod(n, F.lit(100))
    return F.when((last == 1) & (two != 11), one).when(last.between(2, 4) & ~two.between(12, 14), few).otherwise(many)


def iso_date(c: Column) -> Column:
    """dd.MM.yyyy as yyyy-MM-dd; null where it is no date."""
    return F.date_format(F.try_to_date(c, "dd.MM.yyyy"), "yyyy-MM-dd")


def ru_date(c: Column) -> Column:
    """yyyy-MM-dd as dd.MM.yyyy; what is no such date stays as it is."""
    return F.coalesce(F.date_format(F.try_to_date(c, "yyyy-MM-dd"), "dd.MM.yyyy"), c)


def msk_time(c: Column) -> Column:
    """A UTC timestamp as Moscow time, dd.MM.yyyy HH:mm."""
    return F.date_format(F.from_utc_timestamp(c, "Europe/Moscow"), "dd.MM.yyyy HH:mm")


def human_size(n: Column) -> Column:
    one = lambda x: F.format_string("%.1f", x)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" Б"))).when(n < 1024 * 1024, F.concat(one(n / 1024.0), F.lit(" КБ"))).otherwise(F.concat(one(n / 1048576.0), F.lit(" МБ")))


def split_keywords(c: Column) -> Column:
    """Parts between commas and semicolons that stand outside brackets (one level)."""
    parts = F.regexp_extract_all(c, F.lit(r"(?:\([^)]*\)|\[[^\]]*\]|«[^»]*»|[^,;])+"), F.lit(0))
    return F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def expand_indices(c: Column) -> Column:
    """'1, 2, 4-6' as the sorted distinct numbers."""
    parts = F.regexp_extract_all(c, F.lit(r"[0-9]+(?:\s*[-–]\s*[0-9]+)?"), F.lit(0))

    def numbers(x):
        ends = F.transform(F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0)), lambda y: y.cast("int"))
        low, high = F.get(ends, F.lit(0)), F.element_at(ends, -1)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array(low, high))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))


def mail_lines(c: Column) -> Column:
    """The lines of a text that have an @, which no address does without; the rest costs no regular expression."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: F.contains(x, F.lit("@"))), "\n")


def emails(c: Column) -> Column:
    # An address begins with its run of characters or right behind the one before (\\G): no other start in a run is tried, which would cost its length squared.
    return F.regexp_extract_all(mail_lines(c), F.lit(r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))


def orcids(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]"), F.lit(0))


def spins(c: Column) -> Column:
    """Codes of 4-4 digits that stand outside ORCIDs and are no pages of a citation (С. 1005-1012)."""
    rest = F.regexp_replace(c, "[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]", "")
    rest = F.regexp_replace(rest, r"(?<![\p{L}\p{N}])(?:[СCРPсcрp]|pp|PP|стр)\.\s*[0-9]+\s*[-–]\s*[0-9]+", "")
    return F.regexp_extract_all(rest, F.lit("[0-9]{4}-[0-9]{4}"), F.lit(0))


def dois(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"10\.[0-9]{4,9}/[A-Za-z0-9._()/-]*[A-Za-z0-9]"), F.lit(0))


def udk(c: Column) -> Column:
    return F.regexp_extract(c, r"УДК\s*([0-9][0-9.:+/ -]*[0-9]|[0-9])", 1)


def extract_pages(c: Column) -> Column:
    """'5-13' of a citation: the first two numbers after С. or P. behind the double slash; '' without one."""
    tail = F.element_at(F.split(c, "//"), -1)
    return F.when(F.contains(c, F.lit("//")), F.regexp_replace(F.regexp_extract(tail, r"[СCPР]\.\s*([0-9]+\s*[-–]\s*[0-9]+|[0-9]+)", 1), r"\s*[-–]\s*", "-")).otherwise(F.lit(""))


DOI_GRAMMAR = r"10\.18127/j([0-9]{4}-?[0-9]{3}[0-9X])-([0-9]{4})([0-9]{2})-([0-9]+)"


def parse_doi(c: Column) -> Column:
    """struct(issn, year, number, seq); nulls where the grammar does not hold."""
    part = lambda i: F.nullif(F.regexp_extract(c, DOI_GRAMMAR, i), F.lit(""))
    raw = F.replace(part(1), F.lit("-"), F.lit(""))
    issn = F.concat(F.substring(raw, 1, 4), F.lit("-"), F.substring(raw, 5, 4))
    return F.struct(issn.alias("issn"), part(2).cast("int").alias("year"), part(3).cast("int").alias("number"), part(4).cast("int").alias("seq"))


def issue_numbers(c: Column) -> Column:
    """The numbers of '5', '2-3' or '1(1)'; years and what stands in brackets are left out."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", ""), "(19|20)[0-9]{2}", "")
    return F.transform(F.regexp_extract_all(plain, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))


def citation_tail(c: Column) -> Column:
    """struct(journal, volume) of a citation: what follows the double slash up to its first full stop; the number after Т."""
    tail = F.regexp_extract(c, r"//\s*(.*)$", 1)
    return F.struct(F.regexp_extract(tail, r"^([^.]*)", 1).alias("journal"), F.regexp_extract(tail, r"[ТT]\.\s*([0-9]+)", 1).alias("volume"))


def path_parts(c: Column) -> Column:
    """struct(safe, journal, year, folder): slashes unified, empty parts dropped; unsafe with '..' or a zero character."""
    parts = F.filter(F.split(F.translate(c, "\\", "/"), "/"), lambda x: (x != "") & (x != "."))
    safe = ~F.exists(parts, lambda x: x == "..") & ~F.contains(c, F.lit("\0"))
    at = lambda i: F.get(parts, F.lit(i))
    return F.struct(safe.alias("safe"), at(0).alias("journal"), at(1).alias("year"), at(2).alias("folder"))


def mask_secret(c: Column) -> Column:
    """The password of a URL hidden."""
    return F.regexp_replace(c, "(://[^:/@]+):[^@]*@", "$1:***@")


def safe_filename(c: Column) -> Column:
    """The last part of a path with doubtful characters as _, 180 characters at most."""
    name = F.element_at(F.split(F.translate(c, "\\", "/"), "/"), -1)
    return F.substring(F.regexp_replace(name, f"[^0-9{LETTER}._ -]", "_"), 1, 180)


def org_tail(c: Column) -> Column:
    """struct(org, town, country) of 'Org (Town, ..., Country)'; brackets without a comma stay part of the name."""
    inner = F.regexp_extract(c, r"^(.*?)\s*\(([^()]*,[^()]*)\)\s*$", 2)
    parts = F.transform(F.split(inner, ","), lambda x: F.trim(x))
    found = inner != ""
    org = F.when(found, F.regexp_extract(c, r"^(.*?)\s*\(([^()]*,[^()]*)\)\s*$", 1)).otherwise(F.trim(c))
    return F.struct(org.alias("org"), F.when(found, F.element_at(parts, 1)).otherwise(F.lit("")).alias("town"), F.when(found, F.element_at(parts, -1)).otherwise(F.lit("")).alias("country"))


def sentence_case(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 1 << 30)))


def is_initialism(short: Column, phrase: Column) -> Column:
    """Whether short has the first letters of the phrase's words."""
    words = F.filter(F.split(phrase, r"[\s-]+"), lambda x: x != "")
    return (F.size(words) > 1) & (F.lower(short) == F.lower(F.array_join(F.transform(words, lambda x: F.left(x, F.lit(1))), "")))


def recent_flag(c: Column, now: Column, days: int) -> Column:
    return c >= now - F.expr(f"INTERVAL {days} DAYS")


def clean_none(c: Column) -> Column:
    """Blank or 'none' as an empty text."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.lower(t) == "none", F.lit("")).otherwise(t)


def fit_length(c: Column, width: int) -> Column:
    return F.left(c, F.lit(width))


def search_description(needle: Column, journal: Column, status: Column) -> Column:
    """The filters in force, in words."""
    return F.concat_ws(
        "; ",
        F.when(F.coalesce(needle, F.lit("")) != "", F.concat(F.lit("поиск: "), needle)),
        F.when(journal.isNotNull(), F.concat(F.lit("журнал: "), journal)),
        F.when(status.isNotNull(), F.concat(F.lit("статус: "), status)),
    )


def fit_digest(c: Column, limit: int) -> Column:
    """Cut to limit characters at a line end, where the text is longer."""
    return F.when(F.length(c) <= limit, c).otherwise(F.regexp_replace(F.left(c, F.lit(limit)), r"\n[^\n]*\z", ""))


def two_digits(c: Column) -> Column:
    """A number's digits with a zero before a single one; longer numbers stay as they are."""
    return F.when(F.length(c) < 2, F.concat(F.lit("0"), c)).otherwise(c)


def issue_segment(number: Column) -> Column:
    """An issue's number as DOIs hold it: '1' is 01, '1(1)' is 01(01), '100' is 100; anything else stays."""
    n = F.trim(number.cast("string"))
    part = F.regexp_extract_all(n, F.lit("[0-9]+"), F.lit(0))
    padded = F.concat(two_digits(part[0]), F.when(F.size(part) > 1, F.concat(F.lit("("), two_digits(F.get(part, F.lit(1))), F.lit(")"))).otherwise(""))
    return F.when(n.rlike(r"^[0-9]+(\([0-9]+\))?$"), padded).otherwise(n)


def unbroken(c: Column) -> Column:
    """A text whose words are whole again where a hyphen at a line's end cut them; the other line ends stay."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(F.replace(x, F.lit("\t"), F.lit(" "))))
    letter = r"[\p{L}\p{N}_]"
    # The hyphen stands first: a class of letters would be tried at every character.
    return F.regexp_replace(F.array_join(lines, "\n"), f"-\n(?<={letter}-\n)(?={letter})", "")
