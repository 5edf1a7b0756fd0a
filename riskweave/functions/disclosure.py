"""Column functions that read Chinese disclosure text: days, kinds of inquiry, titles, audit opinions, and the context of a hit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.functions.text import first_of
from riskweave.functions.wording import CHINESE, Wording

# Words and patterns of the trade, in the order in which they are tried.
EVENT_TYPES = [
    ("annual_report", "年报问询|年报"),
    ("restructuring", "重组问询|重大资产重组|重组"),
    ("attention", "关注函"),
    ("semi_report", "半年报问询|半年度报告问询"),
    ("quarterly", "三季报问询|一季报问询|季报问询"),
]
CASE_TYPES = [
    ("重组问询函", r"(?s)重组问询|重组.*问询|问询.*重组"),
    ("半年报问询函", "半年报|半年度报告"),
    ("季报问询函", "季报|第三季度"),
    ("年报问询函", "年报|年度报告"),
    ("关注函", "关注函"),
    ("许可类问询函", "许可类"),
]
TITLE_WORDS = "公告|报告|提示|说明|更正|回复|预案|决议"
BIG_FOUR = "普华永道|德勤|安永|毕马威"
# How days, filing numbers, ticked boxes and auditors are written.
_DAY = r"(\d{4})\s*[年./\-]\s*(\d{1,2})\s*[月./\-]\s*(\d{1,2})\s*日?"
_HAN_DAY = r"([〇零一二三四五六七八九]{4})\s*年\s*([〇零一二三四五六七八九十]{1,3})\s*月\s*([〇零一二三四五六七八九十]{1,3})\s*日"
_LETTER_DAY = r"(20\d{2})年(\d{1,2})月(\d{1,2})日"
_FILING_NUMBER = r"公告编号[:：]\s*(\d{4})\s*[-–—]\s*\d+"
_HEADERS = "证券代码|公告编号|^[一二三四五六七八九十]+、"
_BOX, _TICKED, _UNTICKED = r"(?s)非标准审计意见提示(.{0,40})", r"[☑■√✓]\s*适用", r"[☑■√✓]\s*不适用"
_CLEAN, _QUALIFIED = "标准无保留意见", "保留意见|无法表示意见|否定意见"
_FIRM = r"([一-龥]{2,10})会计师事务所"

_SPACE = r"[\s\u3000\u00a0]"


def han_number(text: Column) -> Column:
    """A number written digit by digit, or with 十 for ten, as in 二十六; null if it is neither."""
    digits = lambda c: F.translate(c, "〇零一二三四五六七八九", "00123456789").try_cast("int")
    tens, ones = F.substring_index(text, "十", 1), F.substring_index(text, "十", -1)
    split = F.when(tens == "", 1).otherwise(digits(tens)) * 10 + F.when(ones == "", 0).otherwise(digits(ones))
    return F.when(F.contains(text, F.lit("十")), split).otherwise(digits(text))


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-"), month.cast("string"), F.lit("-"), day.cast("string")).try_cast("date")


def days_in(text: Column, years: tuple[int, int] = (2000, 2030)) -> Column:
    """array<date> of the days that a text names, in Arabic or Chinese numerals, in their order; days that no calendar has are left out."""

    def day(m: Column) -> Column:
        arabic = _date(*[F.regexp_extract(m, _DAY, i) for i in (1, 2, 3)])
        return F.when(m.rlike(r"^\d"), arabic).otherwise(_date(*[han_number(F.regexp_extract(m, _HAN_DAY, i)) for i in (1, 2, 3)]))

    found = F.regexp_extract_all(text, F.lit(f"(?:{_DAY}|{_HAN_DAY})"), 0)
    return F.filter(F.transform(found, day), lambda d: d.isNotNull() & F.year(d).between(*years))


def filing_date(text: Column, fallback_year: Column | None = None) -> Column:
    """The day of an announcement: the last day named that lies in the year of its filing number (or the fallback year), else the last day
    named, else that year's first day."""
    own = F.regexp_extract(text, _FILING_NUMBER, 1).try_cast("int")
    year = own if fallback_year is None else F.coalesce(own, fallback_year.cast("int"))
    days = days_in(text)
    same = F.filter(days, lambda d: F.year(d) == year)
    return F.coalesce(F.try_element_at(same, F.lit(-1)), F.try_element_at(days, F.lit(-1)), F.make_date(year, F.lit(1), F.lit(1)))


def inquiry_date(text: Column, year: Column | None = None) -> Column:
    """The last 20YY年M月D日 of a letter, null if no calendar has it; without any, the middle of `year` if that is given."""
    found = F.regexp_extract_all(F.regexp_replace(text, _SPACE + "+", ""), F.lit(_LETTER_DAY), 0)
    last = F.try_element_at(found, F.lit(-1))
    day = _date(*[F.regexp_extract(last, _LETTER_DAY, i) for i in (1, 2, 3)])
    return day if year is None else F.coalesce(day, F.make_date(year, F.lit(6), F.lit(30)))


def to_day(value: Column) -> Column:
    """A date from epoch milliseconds, epoch seconds or a text that begins with a date."""
    number = value.cast("string").try_cast("double")
    moment = F.when(number > 1e11, F.timestamp_millis(number.cast("long"))).when(number > 1e9, F.timestamp_seconds(number.cast("long")))
    return F.coalesce(moment.cast("date"), F.substring(value.cast("string"), 1, 10).try_cast("date"))


def event_type(text: Column) -> Column:
    return first_of(F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE + "+", ""), EVENT_TYPES, "other")


def case_type(title: Column, text: Column, reach: int = 400) -> Column:
    """The kind of letter by its title and the beginning of its text, where letters name their kind."""
    return first_of(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.substring(F.coalesce(text, F.lit("")), 1, reach)), CASE_TYPES, "问询函")


def title_in(text: Column, fallback: Column, words: str = TITLE_WORDS) -> Column:
    """Of the first 40 lines that are not empty, the first that looks like a title: 4 to 80 characters, a title's word, no header or heading."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, f"^{_SPACE}+|{_SPACE}+$", ""))
    head = F.slice(F.filter(lines, lambda x: x != ""), 1, 40)
    fits = lambda x: x.rlike(words) & F.length(x).between(4, 80) & ~x.rlike(_HEADERS)
    return F.coalesce(F.get(F.filter(head, fits), F.lit(0)), fallback)


def nearby(text: Column, start: Column, length: Column, radius: int = 260) -> Column:
    """A hit (place from 1) with its sentence, at most so many characters to each side; white space becomes single spaces."""
    begin = F.greatest(start - radius, F.lit(1))
    before = F.regexp_replace(F.substring(text, begin, start - begin), r"(?s)^.*[\n。！？；]", "")
    after = F.regexp_extract(F.substring(text, start + length, F.lit(radius)), r"^([^\n。！？；]*[\n。！？；]?)", 1)
    return F.trim(F.regexp_replace(F.concat(before, F.substring(text, start, length), after), _SPACE + "+", " "))


def suppression_reason(label: Column, context: Column, wording: Wording = CHINESE) -> Column:
    """Why a hit in this context is no event: a rule's or template's wording, accounting policy, or nobody acts; empty if it stands."""
    context = F.coalesce(context, F.lit(""))
    out = F.when(F.lit(False), "")
    for reason, pattern in wording.normative:
        out = out.when(context.rlike("(?i)" + pattern), reason)
    if wording.accounting:
        out = out.when(label.startswith(wording.accounting_labels) & context.rlike("(?i)" + wording.accounting), "accounting_policy_or_table")
    for name, who, what in wording.anchors:
        out = out.when((label == name) & ~(context.rlike(who) & context.rlike(what)), "missing_event_anchors")
    return out.otherwise("")


def audit_opinion(text: Column) -> Column:
    """1 for an opinion with qualifications, 0 for a clean one, null if none is found. The ticked box decides before the wording."""
    box = F.regexp_extract(text, _BOX, 1)
    yes, no = F.locate("适用", box), F.locate("不适用", box)
    ticked = F.when(box.rlike(_TICKED), 1).when(box.rlike(_UNTICKED), 0).when(no > 0, (yes < no).cast("int"))
    worded = F.when(F.contains(text, F.lit(_CLEAN)), 0).when(text.rlike(_QUALIFIED), 1)
    return F.coalesce(ticked, worded)


def audit_firm(text: Column) -> Column:
    """The first auditor that is named; empty if none."""
    return F.regexp_extract(text, _FIRM, 1)


def keyword_parts(word: Column) -> Column:
    """A keyword and, where it joins several, its parts."""
    return F.array_distinct(F.filter(F.concat(F.array(word), F.split(word, "[与、，]")), lambda w: w != ""))


def meaningful_chars(text: Column) -> Column:
    """How many letters, digits and Chinese characters a text has."""
    return F.length(F.regexp_replace(text, r"[^A-Za-z0-9㐀-鿿]", ""))


def ocr_status(candidates: Column, skipped: Column, succeeded: Column, failed: Column, enabled: bool = True, available: bool = True) -> Column:
    """What became of the pages of a document that need recognition, by how many there were and how they ended."""
    out = F.when(candidates == 0, "not_needed")
    if not enabled or not available:
        return out.otherwise("not_available" if enabled else "disabled")
    cut = F.when(succeeded > 0, "partial_truncated").otherwise("truncated")
    return out.when(skipped > 0, cut).when((failed > 0) & (succeeded > 0), "partial_failed").when(failed > 0, "failed").otherwise("completed")
