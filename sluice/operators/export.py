"""Export of listings: predicate, row projection, de-duplication and the spreadsheet sink."""

from __future__ import annotations

import datetime
import os
import shutil
import zipfile
from functools import reduce
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import fixed
from sluice.functions.text import blank_to_null, strip
from sluice.operators.dedup import first_of_key
from sluice.operators.listing import experience_label, skills_label

MOST_SHEET_ROWS = 1_048_575


def predicate(as_of: Column, source: str | None = None, location: str | None = None, posted_within_days: int | None = None, exp_min: int | None = None, exp_max: int | None = None) -> Column:
    """Conjunction of the filters asked for; a missing value fails a range test."""
    tests = [F.col("lifecycle_status").isin("active", "unknown")]
    if source:
        tests.append(F.col("source_name") == source.strip().lower())
    if location:
        tests.append(F.col("location").rlike(f"(?iu){location}"))
    if posted_within_days is not None:
        tests.append(F.col("last_seen_at") >= as_of - F.make_dt_interval(F.lit(posted_within_days)))
    if exp_min is not None:
        tests.append(F.col("experience_years_max") >= exp_min)
    if exp_max is not None:
        tests.append(F.col("experience_years_min") <= exp_max)
    return reduce(lambda a, b: a & b, tests)


def cell(x: Column) -> Column:
    """Stripped text; words for 'nothing' become null."""
    s = strip(x.cast("string"))
    return F.when(~F.lower(s).isin(fixed.EMPTY_CELLS), s)


def cell_time(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd HH:mm 'UTC'")


def export_rows(df: DataFrame, run_id: str | None = None) -> DataFrame:
    """The export columns of flat listings, one row per canonical URL (null and '' dropped, first last_seen wins)."""
    one = first_of_key(df.where(F.length("canonical_url") > 0), "canonical_url", "last_seen_at")
    value = {
        "title": cell(F.col("title")), "company": cell(F.col("company")), "location": cell(F.col("location")), "work_mode": cell(F.col("work_mode")),
        "experience": experience_label(F.col("experience_years_min"), F.col("experience_years_max")), "salary_raw": cell(F.col("salary_raw")),
        "skills": skills_label(F.col("required_skills"), F.col("preferred_skills")), "posted_date": cell_time(F.col("posted_at")), "employment_type": cell(F.col("employment_type")), "source": cell(F.col("source_name")),
        "job_url": cell(F.col("canonical_url")), "apply_url": cell(F.coalesce(blank_to_null(F.col("apply_url")), F.col("apply_email"))), "job_id": cell(F.col("canonical_url")), "run_id": F.lit(run_id).cast("string"),
        "first_seen_at": cell_time(F.col("first_seen_at")), "last_seen_at": cell_time(F.col("last_seen_at")), "version": F.col("version_count"), "validation_status": cell(F.col("validation_status")),
        "lifecycle_status": cell(F.col("lifecycle_status")),
    }
    return one.select(*[value[key].alias(key) for _, _, key in fixed.EXPORT_COLUMNS])


def file_name(now: datetime.datetime) -> str:
    return f"job_listings_{now:%Y-%m-%d_%H%M}.xlsx"


def backup_name(path: str, now: datetime.datetime) -> str:
    return f"{path}.bak-{now:%Y%m%d_%H%M}"


def _column(n: int) -> str:
    return chr(65 + n)


def write_xlsx(rows: DataFrame, path: str, overwrite: bool = False, now: datetime.datetime | None = None) -> str:
    """Write export rows as one formatted sheet; an existing file is an error, or kept as a backup if ``overwrite``.

    A sheet holds at most MOST_SHEET_ROWS rows: more is an error (write the rows
    as Parquet or CSV instead). Rows are streamed one partition at a time.
    """
    now = now or datetime.datetime.now(datetime.UTC)
    if os.path.exists(path):
        if not overwrite:
            raise FileExistsError(path)
        shutil.copy2(path, backup_name(path, now))
    if (n := rows.count()) > MOST_SHEET_ROWS:
        raise ValueError(f"{n} rows do not fit a sheet")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    widths = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, (_, w, _) in enumerate(fixed.EXPORT_COLUMNS, 1))

    def line(number: int, values: list, style: int) -> str:
        cells = []
        for i, v in enumerate(values):
            if v is None:
                continue
            ref = f'{_column(i)}{number}" s="{style}"'
            cells.append(f'<c r="{ref}><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{ref} t="inlineStr"><is><t xml:space="preserve">{escape(_printable(str(v)))}</t></is></c>')
        return f'<row r="{number}" ht="16" customHeight="1">{"".join(cells)}</row>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in _PARTS.items():
            z.writestr(name, content)
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            put = lambda s: f.write(s.encode())
            put(f'{_XML}<worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{widths}</cols><sheetData>')
            put(line(1, [h for h, _, _ in fixed.EXPORT_COLUMNS], 1))
            for number, row in enumerate(rows.toLocalIterator(), 2):
                put(line(number, list(row), 0))
            put("</sheetData></worksheet>")
    return path


def _printable(text: str) -> str:
    return "".join(c for c in text if c in "\t\n\r" or ord(c) >= 32)


_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_PARTS = {
    "[Content_Types].xml": f'{_XML}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    f'<Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_TYPE}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{_TYPE}.styles+xml"/></Types>',
    "_rels/.rels": f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'{_XML}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name="Jobs" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": f'{_XML}<styleSheet xmlns="{_MAIN}"><fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><color rgb="FFFFFFFF"/><name val="Calibri"/></font></fonts>'
    '<fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF1F4E79"/></patternFill></fill></fills>'
    '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf xfId="0"/><xf xfId="0" fontId="1" fillId="2" applyFont="1" applyFill="1" applyAlignment="1"><alignment horizontal="center" vertical="center"/></xf></cellXfs></styleSheet>',
}
