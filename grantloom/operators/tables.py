"""Ragged tables: what kind each is, and the typed rows of work package lists, effort matrices and deliverable lists.

A table is a row with proposal, page_idx, table_idx and rows (an array of arrays of strings). Column roles are found from
header words and from the shape of cells, with array functions; each step's arrays are columns of their own, so that
nothing is computed twice.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from grantloom.functions import scalars as S
from grantloom.operators.assembly import last_by

TABLE = ["proposal", "page_idx", "table_idx"]
#: What a table can be, and what it is otherwise.
LABELS, OTHER = ("wp_list", "effort", "deliverable"), "other"
_TEXTS = "array<string>"


def _none() -> Column:
    return F.array().cast(_TEXTS)


def _any_in(text: Column, *words: str) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def _first(cells: Column, keep) -> Column:
    return F.coalesce(F.get(F.filter(cells, keep), F.lit(0)), F.lit(""))


def _whole(pattern: str):
    return lambda c: c.rlike(rf"(?i)^(?:{pattern})$")


def _numbered(rows: str) -> Column:
    """A row of a table for each of its rows, with its place. Of a bare column posexplode() would have Spark ask for its size
    first, and make the column once more for that."""
    return F.posexplode(F.when(F.size(rows) > 0, F.col(rows)))


#: White space but the space, up to ASCII and whole; a tab stands for a null cell.
_ASCII_BLANK, _BLANK = r"[\t-\r]", r"[\t-\r\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def _untidy(text: Column) -> Column:
    """Whether S.clean() may change one of the cells that are joined by bars here."""
    blank = F.when(F.octet_length(text) == F.length(text), text.rlike(_ASCII_BLANK)).otherwise(text.rlike(_BLANK))
    return _any_in(text, "  ", " |", "| ") | text.startswith(" ") | text.endswith(" ") | blank


def cleaned(tables: DataFrame) -> DataFrame:
    """Rows without cells go, and all cells are cleaned. A table is searched as one text first: where that has nothing to clean,
    its cells stay as they are."""
    t = tables.withColumn("_text", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|", "\t")), "|"))
    t = t.withColumns({"_beyond": S.may_change(F.col("_text")), "_untidy": _untidy(F.col("_text"))})
    t = t.withColumn("rows", S.compatible_rows(F.col("rows"), F.col("_beyond")))
    filled = F.filter(F.coalesce("rows", F.array().cast("array<array<string>>")), lambda r: F.size(r) > 0)
    return t.withColumn("rows", F.when(F.col("_beyond") | F.col("_untidy"), F.transform(filled, lambda r: F.transform(r, S.clean))).otherwise(filled)).drop("_text", "_beyond", "_untidy")


# ---------------------------------------------------------------- classification


def worth_classifying(tables: DataFrame) -> DataFrame:
    """Tables of two rows or more of which one has three filled cells; others never come to a label."""
    return S.only(tables, F.coalesce(S.usable_table(F.col("rows")), F.lit(False)))


def _merged(top: Column, second: Column) -> Column:
    """The cells of the first two rows, column by column."""
    cells = lambda row: F.when(row != "", F.split(F.substring(row, F.lit(2), F.length(row)), "\t")).otherwise(_none())
    return F.zip_with(cells(top), cells(second), lambda a, b: F.concat_ws(" ", F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))))


def classified(tables: DataFrame) -> DataFrame:
    """Adds label: wp_list, effort, deliverable, other, or null where no rule is sure. The first rule that holds decides.

    A table is searched as one text in upper case, of a line break before each row and tabs between its cells (clean cells have
    neither, and no white space but single spaces), so that no rule goes through the cells one by one."""
    t = cleaned(tables.withColumnRenamed("rows", "raw").withColumn("rows", F.col("raw")))
    joined = F.array_join(F.transform("rows", lambda r: F.array_join(r, "\t")), "\n")
    t = t.select("*", F.when(F.size("rows") > 0, F.concat(F.lit("\n"), joined)).otherwise("").alias("text"), F.size("rows").alias("n")).drop("rows")
    rest = lambda text, begin: F.substring(text, F.length(begin) + 1, F.length(text))
    t = t.withColumn("upper", F.upper("text"))
    upper, n = F.col("upper"), F.col("n")
    t = t.withColumn("top", F.substring_index(upper, "\n", 2))
    top = F.col("top")
    t = t.withColumn("below", rest(upper, top))
    below, second = F.col("below"), F.substring_index("below", "\n", 2)
    t = t.withColumn("merged", _merged(top, second))
    t = t.withColumn("head", F.array_join("merged", " | "))
    head, merged, body = F.col("head"), F.col("merged"), rest(below, second)
    # A pattern begins with a character that few places have, and what must stand before that is looked at behind it.
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern))
    last, month = r"(?![^\t\n])", r"M(?<=\bM)"  # a cell's end
    acronym = r"[A-Z][A-Z&\-]{1,6}"
    ids = count(upper, rf"\nD(?=[^\t\n]{{0,11}}{last})[0-9]+\.[0-9]+\b")
    wp_rows = count(below, rf"\n(?:[0-9]{{1,2}}{last}|[^\n]*?WP(?<=\bWP) *[0-9]+\b)")
    continued = count(upper, rf"\n(?:[0-9]{{1,2}}|WP *[0-9]+){last}[^\n]*?{month}[0-9]{{1,2}}\b[^\n]*?{month}[0-9]{{1,2}}\b")
    codes = upper.rlike(rf"[\t\n](?:PU|CO|SEN|RE){last}")
    due = upper.rlike(rf"{month}[0-9]+\b")
    number_rows = F.size(F.filter(F.split(body, "\n"), _mostly_numbers))
    pm_header = F.exists(merged, lambda c: _any_in(c, "PERSON", "PM", "MONTH"))
    acronyms = F.size(F.filter(merged, lambda c: _any_in(c, "TOTAL", "PM") | c.rlike(rf"^{acronym}$")))
    partners0 = count(body, rf"\n{acronym}{last}") >= 3
    wps0 = count(body, rf"\nWP *[0-9]+{last}") >= 2
    wps_on_top = count(top, rf"[\t\n]WP *[0-9]+{last}") >= 3
    wordy = F.exists(merged, lambda c: F.size(F.split(c, " ")) >= 4)
    summary = _any_in(head, "WORK PACKAGE TITLE", "WP TITLE") | (_any_in(head, "START") & _any_in(head, "END") & _any_in(head, "LEAD"))
    shaped = pm_header | (acronyms >= F.greatest(F.lit(4), F.floor(F.size(merged) / 2))) | (partners0 & wps0) | wps_on_top
    effort = (n >= 3) & ~summary & ((~wordy & shaped) | pm_header) & (number_rows >= 2)
    titled = _any_in(head, "WP TITLE", "WORK PACKAGE TITLE", "WORKPACKAGE TITLE") & _any_in(head, "LEAD", "SHORT NAME") & _any_in(head, "START") & _any_in(head, "END")
    label = (
        F.when(n == 0, None)
        .when(F.col("text").rlike(r"[\t\n][^\t\n]{401}") & ~upper.rlike(r"\nD[0-9]+\.[0-9]+"), "other")
        .when(upper.rlike(r"MS(?<=\bMS)[0-9]+\b"), "other")
        .when(_any_in(top, "MILESTONE") | _any_in(head, "MEANS OF VERIFICATION"), "other")
        .when(_any_in(top, "WP NUMBER"), "other")
        .when(titled & (wp_rows >= 2), "wp_list")
        .when(continued >= 2, "wp_list")
        .when(_any_in(head, "DELIV", "DEL.", "DISS", "TYPE") & ((codes & due) | (ids >= 2)), "deliverable")
        .when((codes | due) & (ids >= 2), "deliverable")
        .when(effort, "effort")
    )
    return t.select(*[c for c in tables.columns if c != "rows"], F.col("raw").alias("rows"), label.alias("label"))


def _mostly_numbers(row: Column) -> Column:
    """Of a row as text: two cells or more, and a third of the filled ones, are a number (or two)."""
    numeric = F.regexp_count(row, F.lit(r"(?<![^\t])[0-9]+(?: [0-9]+)?(?:\.[0-9]+)?(?![^\t])"))
    return (numeric >= 2) & (numeric >= F.floor(F.regexp_count(row, F.lit(r"[^\t]+")) / 3))


def with_fallback_label(tables: DataFrame, label_of) -> DataFrame:
    """Rules first; only tables without a label go through label_of, a function from DataFrame to one with a column label.

    Two branches and a union, as Catalyst doesn't promise to leave an expensive function out of a coalesce()."""
    ruled = classified(tables)
    sure = S.only(ruled, F.col("label").isNotNull()).withColumn("label_source", F.lit("rules"))
    asked = label_of(S.only(ruled, F.col("label").isNull()).drop("label")).withColumn("label_source", F.lit("model"))
    return sure.unionByName(asked.withColumn("label", F.coalesce("label", F.lit("other"))))


def model_preview(rows: Column, most: int = 20) -> Column:
    """What a model is shown of a table: its first rows, cells between bars."""
    some = F.filter(F.slice(rows, 1, most), lambda r: F.size(r) > 0)
    return F.array_join(F.transform(some, lambda r: F.array_join(F.transform(F.filter(r, lambda c: c.isNotNull()), S.clean), " | ")), "\n")


def model_label(answer: Column, known: tuple[str, ...] = LABELS) -> Column:
    """The label that a model's answer is, or else the first one that it holds; OTHER if it holds none or there is no answer."""
    text = F.lower(F.btrim(answer))
    within = F.filter(F.array(*map(F.lit, known)), lambda label: F.contains(text, label))
    return F.when(text.isin(*known, OTHER), text).otherwise(F.coalesce(F.get(within, F.lit(0)), F.lit(OTHER)))


def answers_by(ask: Callable[[list[str]], list[str | None]]) -> Callable[[Column], Column]:
    """A model's answers as a column function: ask gets texts and gives answers, in the same order, inside tasks. Where it
    fails (any exception) there is no answer."""

    @F.pandas_udf("string")
    def answers(texts: pd.Series) -> pd.Series:
        try:
            return pd.Series(ask(texts.tolist()), dtype=object)
        except Exception:
            return pd.Series([None] * len(texts), dtype=object)

    return answers


def labelled_by(ask: Callable[[list[str]], list[str | None]], most: int = 20):
    """A label_of for with_fallback_label(), from a model that is shown previews; tables without an answer become OTHER."""
    answers = answers_by(ask)
    return lambda tables: tables.withColumn("answer", answers(model_preview(F.col("rows"), most))).withColumn("label", model_label(F.col("answer"))).drop("answer")


def routed(pages: DataFrame) -> DataFrame:
    """Adds extractor for pages with tables (array of tables), images, width, height and effort_found: rotated text and
    pages without a usable table go to the structure extractor, and a page that is a large image to OCR while no earlier
    page of the proposal had effort."""
    earlier = W.partitionBy("proposal").orderBy("page_idx").rowsBetween(W.unboundedPreceding, -1)
    found = F.coalesce(F.max(F.col("effort_found").cast("int")).over(earlier), F.lit(0)) > 0
    usable = F.exists("tables", S.usable_table)
    choice = (
        F.when(F.exists("tables", S.is_rotated_table), "structure")
        .when(~usable & S.has_large_image(F.col("images"), F.col("width"), F.col("height")) & ~found, "ocr")
        .when(~usable, "structure")
        .otherwise("native")
    )
    return pages.withColumn("extractor", choice)


def picked(labelled: DataFrame, reach: int = 3) -> DataFrame:
    """The tables that count: work package lists up to reach pages after the first, one effort table (one by rules before
    one by a model, then the earliest), and all deliverable lists."""
    by = W.partitionBy("proposal", "label")
    order = by.orderBy((F.col("label_source") != "rules").cast("int"), "page_idx", "table_idx")
    rows = S.only(labelled, F.col("label") != "other").withColumns({"first": F.min("page_idx").over(by), "rank": F.row_number().over(order)})
    keep = ((F.col("label") == "wp_list") & (F.col("page_idx") - F.col("first") <= reach)) | ((F.col("label") == "effort") & (F.col("rank") == 1)) | (F.col("label") == "deliverable")
    return rows.filter(keep).drop("first", "rank")


def joined_fragments(tables: DataFrame) -> DataFrame:
    """A proposal's fragments as one table, in page order; a proposal's own pages bound its size."""
    parts = F.sort_array(F.collect_list(F.struct("page_idx", "table_idx", "rows")))
    return tables.groupBy("proposal").agg(F.flatten(F.transform(parts, lambda x: x["rows"])).alias("rows"))


# ---------------------------------------------------------------- typed rows


def work_package_list(tables: DataFrame, strict: bool = False) -> DataFrame:
    """proposal, wp_id, title, leader, pms, start, end from joined fragments; of repeated ids the last row counts.

    A second row with header words is part of the header unless it names a work package. strict: NO counts as a whole
    word only, so that a first data row such as "Innovation" is not taken for a header."""
    t = S.only(cleaned(tables), F.size("rows") >= 2)
    second = F.coalesce(F.get("rows", F.lit(1)), _none())
    words = (lambda c: _any_in(c, "NUMBER", "MONTH", "SHORT NAME") | c.rlike(r"\bNO\b")) if strict else (lambda c: _any_in(c, "NO", "NUMBER", "MONTH", "SHORT NAME"))
    two = (F.size("rows") > 2) & F.exists(second, lambda c: words(S.norm_cell(c))) & ~F.exists(second, lambda c: c.rlike(r"(?i)\bWP\s*[0-9]+\b"))
    t = t.withColumn("skip", F.when(two, 2).otherwise(1))
    t = t.withColumn("header", S.merged_header(F.col("rows"), F.col("skip")))
    t = t.withColumns({
        "c_wp": S.find_column(F.col("header"), ("WP",), ("TITLE", "WORK PACKAGE")),
        "c_title": S.find_column(F.col("header"), ("WP TITLE", "WORK PACKAGE TITLE", "WORKPACKAGE TITLE")),
        "c_leader": S.find_column(F.col("header"), ("SHORT NAME", "LEADER", "LEAD"), ("NO", "NUMBER")),
        "c_pm": S.find_column(F.col("header"), ("PERSON", "PM"), ("START", "END", "MONTH START", "MONTH END")),
        "c_start": S.find_column(F.col("header"), ("START",)),
        "c_end": S.find_column(F.col("header"), ("END",)),
    })
    rows = t.select("proposal", "c_wp", "c_title", "c_leader", "c_pm", "c_start", "c_end", "skip", _numbered("rows").alias("pos", "row")).filter((F.col("pos") >= F.col("skip")) & F.exists("row", lambda c: c != ""))
    at = lambda c: F.coalesce(F.get("row", F.col(c)), F.lit(""))
    number, row = r"[0-9]+[.,]?[0-9]*", F.col("row")
    named = lambda text: F.regexp_extract(text, r"(?i)W(?<=\bW)P *([0-9]+)\b", 1)
    rows = rows.withColumn("text", F.concat(F.lit("\t"), F.array_join("row", "\t")))  # clean cells have no tabs
    rows = rows.withColumns({
        "id": F.coalesce(F.nullif(named(at("c_wp")), F.lit("")), F.nullif(named(F.col("text")), F.lit("")), F.nullif(F.regexp_extract("text", r"\t([0-9]{1,2})(?![^\t])", 1), F.lit(""))),
        "title0": at("c_title"), "leader0": at("c_leader"), "pm0": at("c_pm"), "start0": S.clean_month_token(at("c_start")), "end0": S.clean_month_token(at("c_end")),
    })
    rows = S.only(rows, F.col("id").isNotNull())
    # What only rows without a value in its column need is made for these alone.
    sure = F.col("pm0").rlike(f"^{number}$")
    rows = rows.withColumns({
        "numbers": F.when(~sure, F.regexp_extract_all("text", F.lit(rf"\t({number})(?![^\t])"), F.lit(1))),
        "tokens": F.when((F.col("start0") == "") | (F.col("end0") == ""), S.month_tokens(row)),
    })
    long_text = _first(row, lambda c: (F.length(c) > 6) & ~_whole(rf"WP\s*[0-9]+|{number}|M?[0-9]+")(c) & ~c.rlike(r"^[A-Z][A-Z0-9&\-]{1,9}$"))
    word = _first(row, lambda c: _whole(r"[A-Z]+(?:[&\-][A-Z]+)*")(c) & ~_whole(r"WP\s*[0-9]+")(c))
    n = F.size("numbers")
    decimal = _first(F.col("numbers"), lambda c: c.rlike("[.,]"))
    guessed = F.when(decimal != "", decimal).when(n >= 3, F.get("numbers", n - 3)).when(n > 0, F.get("numbers", n - 1)).otherwise("")
    pm = F.when(F.col("numbers").isNull(), F.col("pm0")).otherwise(guessed)
    k = F.size("tokens")
    lost = F.coalesce(k >= 2, F.lit(False)) & F.col("tokens").isNotNull()
    typed = rows.select(
        "proposal", F.concat(F.lit("WP"), "id").alias("wp_id"), "pos",
        F.when((F.col("title0") == "") | _whole(r"WP\s*[0-9]+")(F.col("title0")), long_text).otherwise(F.col("title0")).alias("title"),
        F.when(F.col("leader0") == "", word).otherwise(F.col("leader0")).alias("leader"),
        S.to_float(pm).alias("pms"),
        F.when(lost, F.get("tokens", k - 2)).otherwise(F.col("start0")).alias("start"),
        F.when(lost, F.get("tokens", k - 1)).otherwise(F.col("end0")).alias("end"),
    )
    return last_by(typed, ["proposal", "wp_id"], F.col("pos")).drop("pos")


def effort_matrix(tables: DataFrame, company: str, expected: DataFrame | None = None) -> DataFrame:
    """proposal, company, wp_id, person_months.

    Partners in the header: the company's column, by rows that name a work package or, if none does, row by row for the
    expected work packages in numeric order. Work packages in a header row: the company's row (its name between slashes
    or cell edges), each cell or else its left or right neighbour. expected: proposal, wp_id."""
    name = company.upper().strip()
    t = S.only(cleaned(tables), F.size("rows") > 0)
    t = t.withColumn("col", F.array_position(F.transform(F.get("rows", F.lit(0)), F.upper), F.lit(name)).cast("int") - 1)
    by_column = t.filter(F.col("col") >= 0).select("proposal", "col", _numbered("rows").alias("pos", "row")).filter(F.col("pos") > 0)
    filled = F.filter("row", lambda c: c != "")
    by_column = by_column.withColumns({
        "value": S.to_float(F.coalesce(F.get("row", F.col("col")), F.lit(""))),
        "id": F.regexp_extract(F.coalesce(F.get("row", F.lit(0)), F.lit("")), r"(?i)^WP([0-9]+)$", 1),
        "numeric": (F.size(filled) > 0) & (F.size(F.filter(filled, lambda c: c.rlike("[0-9]"))) >= F.greatest(F.lit(3), F.floor(F.size(filled) / 2))),
    })
    by_column = by_column.withColumn("explicit", F.max((F.col("id") != "").cast("int")).over(W.partitionBy("proposal")) == 1)
    explicit = last_by(by_column.filter(F.col("explicit") & (F.col("id") != "")).select("proposal", F.concat(F.lit("WP"), "id").alias("wp_id"), "pos", F.col("value").alias("person_months")), ["proposal", "wp_id"], F.col("pos")).drop("pos")
    counted = by_column.filter(~F.col("explicit") & F.col("numeric")).withColumn("place", F.row_number().over(W.partitionBy("proposal").orderBy("pos")))
    if expected is None:
        positional = counted.select("proposal", F.concat(F.lit("WP"), F.col("place").cast("string")).alias("wp_id"), F.col("value").alias("person_months"))
    else:
        number = F.regexp_extract("wp_id", "([0-9]+)", 1).try_cast("int")
        places = expected.select("proposal", "wp_id", F.row_number().over(W.partitionBy("proposal").orderBy(number, "wp_id")).alias("place"))
        positional = counted.join(places, ["proposal", "place"]).select("proposal", "wp_id", F.col("value").alias("person_months"))
    by_row = t.filter(F.col("col") < 0).select("proposal", _numbered("rows").alias("pos", "row"))
    by_row = by_row.withColumns({
        "named": F.filter(F.transform("row", lambda c, i: F.struct(i.alias("i"), F.upper(c).alias("wp"))), lambda x: x["wp"].rlike("^WP[0-9]+$")),
        "ours": F.exists("row", lambda c: F.exists(F.split(F.upper(c), "/"), lambda p: F.trim(p) == name)),
    })
    headers = by_row.filter(F.size("named") >= 3).groupBy("proposal").agg(F.min_by(F.struct("pos", "named"), "pos").alias("h"))
    ours = by_row.join(headers, "proposal").filter((F.col("pos") > F.col("h.pos")) & F.col("ours")).groupBy("proposal").agg(F.min_by(F.struct("row", "h"), "pos").alias("x"))
    cells = ours.select("proposal", F.col("x.row").alias("row"), F.explode("x.h.named").alias("at"))
    near = F.transform(F.array(F.col("at.i"), F.col("at.i") - 1, F.col("at.i") + 1), lambda i: F.coalesce(F.get("row", i), F.lit("")))
    by_row = cells.select("proposal", F.col("at.wp").alias("wp_id"), S.to_float(_first(near, lambda c: c.rlike("[0-9]"))).alias("person_months"))
    every = explicit.unionByName(positional).unionByName(by_row)
    return every.select("proposal", F.lit(name).alias("company"), "wp_id", "person_months")


#: What a cell of a deliverable list may say of its type and dissemination.
TYPES, LEVELS = "R|DEM|DMP|DEC|OTHER", "PU|SEN|CO|RE"


def _deliverable_rows(tables: DataFrame) -> DataFrame:
    """Rows with an id, a lead, a type and months, and what is read of each whatever the reading."""
    rows = cleaned(tables).select(*TABLE, _numbered("rows").alias("row_ord", "row"))
    row = F.col("row")
    rows = S.only(rows.withColumn("id_cell", _first(row, S.has_deliverable_id)), F.col("id_cell") != "")
    rows = rows.withColumns({
        "lead": _first(row, lambda c: (F.length(c) <= 9) & _whole(r"[A-Z]+(?:[&\-][A-Z]+)*")(c) & ~_whole(rf"WP[0-9]+|{TYPES}|{LEVELS}")(c)),
        "kinds": _first(row, lambda c: c.rlike(rf"(?i)\b(?:{TYPES})\b")),
        "month_cells": F.filter("row", lambda c: c.rlike("M[0-9]+")),
    })
    rows = S.only(rows, (F.col("lead") != "") & (F.col("kinds") != "") & (F.size("month_cells") > 0))
    return rows.withColumns({
        "ids": S.deliverable_ids(F.col("id_cell")),
        "wp_cell": F.regexp_extract(_first(row, _whole(r"WP\s*[0-9]+")), "([0-9]+)", 1),
        "type": F.array_join(F.array_distinct(F.transform(F.regexp_extract_all("kinds", F.lit(rf"(?i)\b({TYPES})\b"), F.lit(1)), F.upper)), ", "),
        "months": F.flatten(F.transform("month_cells", lambda c: F.regexp_extract_all(c, F.lit("(M[0-9]+)"), F.lit(1)))),
    })


def _level(strict: bool) -> Column:
    level = _first(F.col("row"), _whole(LEVELS) if strict else lambda c: c.rlike(f"(?i)(?:{LEVELS})"))
    return F.upper(F.regexp_extract(level, f"(?i)({LEVELS})", 1))


def _typed_deliverables(rows: DataFrame) -> DataFrame:
    """Rows that have their dissemination, as deliverables. rows may have more columns in front of TABLE."""
    rows = S.only(rows, F.col("dissemination") != "")
    rows = rows.withColumn("wp", F.concat(F.lit("WP"), F.when(F.col("wp_cell") != "", F.col("wp_cell")).otherwise(F.regexp_extract(F.get("ids", F.lit(0)), r"^D([0-9]+)\.", 1))))
    rows = rows.withColumn("used", F.concat(F.col("month_cells"), F.array("id_cell", "wp", "lead", "type", "dissemination")))
    texts = F.filter("row", lambda c: (F.length(c) > 8) & ~F.array_contains("used", c) & ~c.rlike(r"(?i)^(?:D[0-9]|WP|M[0-9])"))
    rows = rows.withColumn("texts", texts).withColumns({"a": F.coalesce(F.get("texts", F.lit(0)), F.lit("")), "b": F.coalesce(F.get("texts", F.lit(1)), F.lit(""))})
    swap = (F.col("b") != "") & (F.length("a") > F.length("b"))
    before = rows.columns[: rows.columns.index(TABLE[0])]
    return rows.select(*before, *TABLE, "row_ord", "ids", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("name"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("description"), "wp", "lead", "type", "dissemination", "months")


def deliverable_list(tables: DataFrame, strict: bool = False) -> DataFrame:
    """proposal, page_idx, table_idx, row_ord, ids, name, description, wp, lead, type, dissemination, months.

    Rows count if they have ids, lead, type, dissemination and months. strict: the dissemination level is a whole cell;
    otherwise it may be part of any word. The longer of the two texts is the description."""
    return _typed_deliverables(_deliverable_rows(tables).withColumn("dissemination", _level(strict)))


def deliverable_readings(tables: DataFrame) -> DataFrame:
    """deliverable_list() loosely and strictly, with a column reading in front: tables are gone through once, as the readings
    differ in the level alone."""
    rows = _deliverable_rows(tables).withColumns({"loose": _level(False), "strict": _level(True)})
    readings = F.inline(F.array(*[F.struct(F.lit(x).alias("reading"), F.col(x).alias("dissemination")) for x in ("loose", "strict")]))
    each = rows.select("*", readings).drop("loose", "strict")
    return _typed_deliverables(each.select("reading", *[c for c in each.columns if c != "reading"]))
