"""Column functions for proposal text: cells, months, ids, dates, labels. All run in the JVM but compatible()."""

from __future__ import annotations

import json
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from grantloom.functions.patterns import DASH, NUMBER, begins, either, loose

#: Fixed values of the domain.
EVERYONE = ("ALL", "ALL PARTNERS")
GREEK_MU = "Μ"
DASHES = "–—"

_MISSING = ""


#: Text without these is in the compatibility form as it is: all others never change, join with no neighbour, and are no marks.
_MAY_CHANGE = "[^\\x00-\\x7F\\u00C0-\\u00FF\\u2010\\u2012-\\u2016\\u2018-\\u201F]"


@arrow_udf(StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    # pyarrow's own utf8_normalize() leaves accents apart in this form.
    return pa.array([x if x is None else unicodedata.normalize("NFKC", x) for x in text.to_pylist()], pa.string())


@arrow_udf(StringType())
def _nfkc_cells(rows: pa.Array) -> pa.Array:
    # Tables come as JSON: of nested lists, null or not, Spark asks the size of the whole batch with each row.
    one = lambda cell: cell if cell is None else unicodedata.normalize("NFKC", cell)
    return pa.array([x if x is None else json.dumps([r if r is None else list(map(one, r)) for r in json.loads(x)]) for x in rows.to_pylist()], pa.string())


def may_change(text: Column) -> Column:
    """Text in ASCII, which has as many bytes as characters, isn't searched."""
    return (F.octet_length(text) != F.length(text)) & text.rlike(_MAY_CHANGE)


def compatible(text: Column) -> Column:
    """Unicode's compatibility form, the one thing here that Spark has no function for; only text that it may change leaves the JVM."""
    return F.coalesce(_nfkc(F.when(may_change(text), text)), text)


def compatible_rows(rows: Column, beyond: Column | None = None) -> Column:
    """The same of a table's cells. beyond: whether the form may change one of them, where that is known already."""
    if beyond is None:
        beyond = F.exists(rows, lambda r: F.exists(r, lambda c: may_change(F.coalesce(c, F.lit("")))))
    changed = _nfkc_cells(F.when(beyond, F.to_json(rows)))
    return F.coalesce(F.from_json(changed, "array<array<string>>"), rows)


def clean(text: Column) -> Column:
    """White space runs become one space, ends are trimmed, null is empty. Text beyond ASCII must have been through
    compatible() before: column functions can't normalise it, and array functions can't call what can."""
    # A single space stays as it is and isn't replaced by another one.
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit(_MISSING)), r"(?U)[\s&&[^ ]]\s*| \s+", " "))


def norm_cell(cell: Column) -> Column:
    return F.upper(clean(cell))


def partner_match(partners: Column, company: Column) -> Column:
    """The company is a partner, or everyone is."""
    names = F.transform(partners, lambda x: F.upper(F.trim(x)))
    return F.coalesce(F.arrays_overlap(names, F.array(F.upper(F.trim(company)), *map(F.lit, EVERYONE))), F.lit(False))


def first_listed(partners: Column) -> Column:
    return F.coalesce(F.get(partners, F.lit(0)), F.lit(_MISSING))


def month_number(token: Column) -> Column:
    """The first run of digits; 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(token, F.lit("")), r"([0-9]+)", 1), F.lit("")).try_cast("int"), F.lit(0))


def month_token(value: Column) -> Column:
    """M and at least two digits, for an optional M (Latin or Greek) and digits; else empty."""
    return clean_month_token(clean(value))


def clean_month_token(cell: Column) -> Column:
    """The same of a cell that is cleaned."""
    digits = _month_digits(cell)
    return F.when(digits == "", _MISSING).otherwise(m_token(digits.try_cast("int")))


def _month_digits(text: Column) -> Column:
    return F.regexp_extract(F.upper(F.translate(text, GREEK_MU, "M")), r"^M?\s*([0-9]+)$", 1)


def month_tokens(cells: Column) -> Column:
    """month_token() of those cleaned cells that have one. A function's argument is written out at each use within array
    functions, so each step is an array of its own."""
    numbers = F.filter(F.transform(F.filter(F.transform(cells, _month_digits), lambda d: d != ""), lambda d: d.try_cast("int")), lambda n: n.isNotNull())
    return F.transform(numbers, m_token)


def m_token(number: Column) -> Column:
    """M05 for 5; numbers of three digits stay whole."""
    return F.concat(F.when(number.between(0, 9), "M0").otherwise("M"), number.cast("string"))


def to_float(cell: Column) -> Column:
    """The first number, with a decimal comma or point; 0 without one."""
    found = F.regexp_extract(F.translate(F.coalesce(cell, F.lit("")), ",", "."), r"([0-9]+(?:\.[0-9]+)?)", 1)
    return F.coalesce(found.try_cast("double"), F.lit(0.0))


def deliverable_ids(cell: Column) -> Column:
    """D1.2 - D1.4 in one work package and ascending is a range; otherwise all ids, in upper case."""
    text = F.translate(clean(cell), DASHES, "--")
    span = r"(?i)^D([0-9]+)\.([0-9]+)\s*-\s*D([0-9]+)\.([0-9]+)$"
    wp, low, wp2, high = (F.regexp_extract(text, span, k).try_cast("int") for k in (1, 2, 3, 4))
    ids = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)(D[0-9]+\.[0-9]+)"), F.lit(1)), lambda x: F.upper(x))
    ranged = F.when((wp == wp2) & (low <= high), F.transform(F.sequence(F.least(low, high), high), lambda n: F.concat(F.lit("D"), wp.cast("string"), F.lit("."), n.cast("string"))))
    return F.coalesce(F.when(text.rlike(span), ranged), ids)  # the span's four numbers are read where there is one


def has_deliverable_id(cell: Column) -> Column:
    return F.coalesce(cell, F.lit(_MISSING)).rlike(r"(?i)\bD[0-9]+\.[0-9]+\b")  # white space and dashes alike end a word


def month_date(start: Column, token: Column, end_of_month: bool = False) -> Column:
    """The day a month of the project begins, or the day before the next begins; null without a month."""
    n = month_number(token)
    day = F.add_months(start, n - 1)
    return F.when(n > 0, F.date_sub(F.add_months(day, 1), 1) if end_of_month else day)


def planner_date(start: Column, token: Column, end_of_month: bool = False) -> Column:
    return F.concat(month_date(start, token, end_of_month).cast("string"), F.lit("T17:00:00Z"))


def milestone_date(start: Column, token: Column, end_of_month: bool = False) -> Column:
    return F.concat(month_date(start, token, end_of_month).cast("string"), F.lit("T08:00:00Z"))


def now_iso() -> Column:
    """The time of the query in UTC, to seconds."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def slug(text: Column) -> Column:
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), F.lit("")), F.lit("proposal"))


def label_color(name: Column) -> Column:
    return F.substring(F.md5(name.cast("binary")), 1, 6)


def months_range(start: Column, end: Column) -> Column:
    return F.when((start != "") & (end != ""), F.concat(start, F.lit("–"), end)).otherwise(F.coalesce(F.nullif(start, F.lit("")), F.nullif(end, F.lit("")), F.lit("")))


def joined_title(left: Column, right: Column) -> Column:
    """Two parts with a middle dot between; what an empty part leaves at the ends goes."""
    return F.btrim(F.concat(left, F.lit(" · "), right), F.lit(" ·-"))


def without_code_fence(text: Column) -> Column:
    """The inside of a fenced block, without its language mark."""
    inner = F.regexp_replace(F.regexp_replace(F.btrim(text), r"^`+|`+$", ""), r"^json", "")
    return F.when(F.btrim(text).startswith("```"), F.btrim(inner)).otherwise(F.btrim(text))


#: The keys that a task must have, present though perhaps empty.
TASK_KEYS = ("id", "wp_id", "title", "start_month", "end_month", "partners", "description")


def parsed_tasks(answer: Column) -> Column:
    """The valid tasks of a JSON array (fenced or not): every key is there, perhaps with null, and partners is a list; else
    an empty array. JSON with a key twice in an object is as good as none.

    The answer is parsed once, as a variant; what is asked of its elements is read from that."""
    elements = F.try_variant_get(F.try_parse_json(without_code_fence(answer)), "$", "array<variant>")
    objects = F.transform(F.coalesce(elements, F.array().cast("array<variant>")), lambda x: F.try_variant_get(x, "$", "map<string,variant>"))
    keys = F.array(*map(F.lit, TASK_KEYS))
    whole = F.filter(objects, lambda x: (F.size(F.array_intersect(F.map_keys(x), keys)) == len(TASK_KEYS)) & F.coalesce(F.schema_of_variant(x["partners"]).startswith("ARRAY"), F.lit(False)))
    kind = lambda k: "array<string>" if k == "partners" else "string"
    return F.transform(whole, lambda x: F.struct(*[F.try_variant_get(x[k], "$", kind(k)).alias(k) for k in TASK_KEYS]))


def quality_score(title: Column, start: Column, end: Column, partners: Column, description: Column) -> Column:
    """How complete a task is: partners 10, both months 10, a title in upper case 5, one for 50 characters of description, 20 at most."""
    return (
        F.when(F.coalesce(F.size(partners), F.lit(0)) > 0, 10).otherwise(0)
        + F.when((F.coalesce(start, F.lit("")) != "") & (F.coalesce(end, F.lit("")) != ""), 10).otherwise(0)
        + F.when(F.coalesce(title, F.lit("")).rlike(r"^\p{Lu}"), 5).otherwise(0)
        + F.floor(F.least(F.length(F.coalesce(description, F.lit(""))), F.lit(1000)) / 50).cast("int")
    )


def progress_percent(done: Column, total: Column) -> Column:
    """Task extraction takes the job from 40 to 85 percent."""
    return F.least(40 + F.floor(45 * done / F.greatest(total, F.lit(1))), F.lit(85)).cast("int")


# ---------------------------------------------------------------- rows


def only(rows: DataFrame, condition: Column) -> DataFrame:
    """The rows for which a condition on computed columns holds. Spark moves a filter below the columns that it asks for and
    writes their expressions out once more for each mention, down to the last cell; it leaves an explode() where it is."""
    return rows.select("*", F.explode(F.when(condition, F.array(F.lit(True)))).alias("_kept")).drop("_kept")


# ---------------------------------------------------------------- pages and ragged tables


def leads_to_page(line: Column) -> Column:
    """Dots, four or more, lead to a number."""
    return line.rlike(r"\.{4,}\s*" + NUMBER)


def is_toc_page(text: Column) -> Column:
    """Five lines that lead to a page."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), leads_to_page)) >= 5


#: What the headings of sections 3 and 4 are about.
THEMES = {3: ("QUALITY", "IMPLEMENTATION", "WORK PLAN", "EFFICIENCY"), 4: ("ETHICS", "BUDGET", "ANNEX", "FINANCIAL")}


def names_section(text: Column, number: int, mark: str, at_start: bool = False, between: str = "") -> Column:
    """A section's number and mark, then one of its themes: text is taken apart at each such number, and one of the parts
    begins with a theme. at_start: nothing but white space may precede the number."""
    parts = F.split(F.coalesce(text, F.lit("")), rf"\b{number}{mark}\s*{between}")
    themed = lambda part: begins(part, either(map(loose, THEMES[number])))
    if at_start:
        return (F.btrim(F.get(parts, F.lit(0)), F.lit(" \t\r\n")) == "") & F.coalesce(themed(F.get(parts, F.lit(1))), F.lit(False))
    return F.exists(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), themed)


def is_section3_page(text: Column) -> Column:
    """Prose under a heading of section 3: three lines of more than 80 characters, and none that leads to a page number."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x))
    titled = F.exists(lines, lambda x: x.rlike(rf"Section\s+3\s*{DASH}") | names_section(x, 3, r"[.\s]", at_start=True))
    return titled & (F.size(F.filter(lines, lambda x: F.length(x) > 80)) >= 3) & ~F.exists(lines, leads_to_page)


def populated(row: Column) -> Column:
    """Cells of a row that aren't blank."""
    return F.size(F.filter(row, lambda c: F.btrim(F.coalesce(c, F.lit(""))) != ""))


def usable_table(rows: Column) -> Column:
    return (F.size(rows) >= 2) & F.exists(rows, lambda r: populated(r) >= 3)


def has_large_image(images: Column, width: Column, height: Column, share: float = 0.06) -> Column:
    return F.coalesce(F.exists(images, lambda i: (i["width"] * i["height"]) / F.nullif(width * height, F.lit(0.0)) >= share), F.lit(False))


def _rotated_cell(cell: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(cell, F.lit("")), "\n"), lambda x: F.btrim(x) != "")
    return (F.size(lines) >= 3) & (F.size(F.filter(lines, lambda x: F.length(F.btrim(x)) <= 2)) >= 0.6 * F.size(lines))


def is_rotated_table(rows: Column) -> Column:
    """Cells of one or two characters a line: 30 % of the first row's or 20 % of all."""
    first, cells = F.coalesce(F.get(rows, F.lit(0)), F.array().cast("array<string>")), F.flatten(rows)
    filled = lambda a: F.filter(a, lambda c: F.coalesce(c, F.lit("")) != "")
    share = lambda a: F.size(F.filter(a, _rotated_cell)) / F.greatest(F.size(filled(a)), F.lit(1))
    return F.coalesce((share(first) >= 0.3) | (share(cells) >= 0.2), F.lit(False))


def merged_header(rows: Column, count: Column | int = 2) -> Column:
    """The first one or two rows, column by column, in upper case."""
    head = F.slice(rows, 1, count)
    width = F.coalesce(F.array_max(F.transform(head, lambda r: F.size(r))), F.lit(0))
    columns = F.when(width > 0, F.sequence(F.lit(0), F.greatest(width, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(columns, lambda i: F.array_join(F.filter(F.transform(head, lambda r: norm_cell(F.get(r, i))), lambda x: x != ""), " "))


def find_column(header: Column, needles: tuple[str, ...], reject: tuple[str, ...] = ()) -> Column:
    """The first column whose header has a needle and no rejected word; null without one."""
    has = lambda h, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(h, w)) if words else F.lit(False)
    spots = F.filter(F.transform(header, lambda h, i: F.when(has(h, needles) & ~has(h, reject), i)), lambda i: i.isNotNull())
    return F.get(spots, F.lit(0))
