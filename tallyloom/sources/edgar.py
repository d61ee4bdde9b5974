"""Landed JSON and XML of the filing register as fact rows.

All functions take DataFrames of what was landed; nothing is fetched.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import periods
from tallyloom.operators.facts import canonical_field

C = F.col
COMPANY_FACTS = "entityName string, facts struct<`us-gaap`: map<string, struct<units: map<string, array<struct<start: string, end: string, instant: string, val: double, fy: int, fp: string, form: string>>>>>>"
SUBMISSIONS = "name string, filings struct<recent: struct<form: array<string>, filingDate: array<string>, reportDate: array<string>, accessionNumber: array<string>, primaryDocument: array<string>>, files: array<struct<name: string>>>"
TICKERS = "map<string, struct<ticker: string, title: string, cik_str: long>>"
FORM_GROUPS = {"10-K": ("10-K", "10-K/A", "20-F", "20-F/A"), "10-Q": ("10-Q", "10-Q/A", "6-K")}


def unit_label(c: Column) -> Column:
    """`USD/shares` as `USD/share`, prefixes before a colon cut."""
    last = lambda x: F.element_at(F.split(x, ":"), -1)
    ratio = r"^\s*([A-Za-z0-9:]+)\s*/\s*([A-Za-z0-9:]+)\s*$"
    over = last(F.regexp_extract(c, ratio, 2))
    over = F.when(F.lower(over).isin("share", "shares"), "share").otherwise(over)
    return F.when(c.rlike(ratio), F.concat(last(F.regexp_extract(c, ratio, 1)), F.lit("/"), over)).otherwise(last(F.trim(F.coalesce(c, F.lit("")))))


def company_facts(landed: DataFrame, form: str = "10-K", key: str = "cik", json: str = "json") -> DataFrame:
    """Fact rows of landed company facts: `form` must be part of the fact's form.

    A fact with a start and an end is a duration, one with an end or instant
    alone a point in time; bad dates and periods without a label drop the
    fact, a missing value counts as 0.
    """
    j = landed.select(key, F.from_json(json, COMPANY_FACTS).alias("j")).select(key, C("j.entityName").alias("company_name"), F.explode(C("j.facts")["us-gaap"]).alias("tag", "t"))
    j = j.select(key, "company_name", "tag", F.explode("t.units").alias("unit", "list")).select(key, "company_name", "tag", "unit", F.explode("list").alias("f"))
    end_text = F.coalesce(F.nullif(C("f.end"), F.lit("")), C("f.instant"))
    start_text = F.nullif(C("f.start"), F.lit(""))
    rows = j.where(C("f.form").contains(form)).select(
        key, "company_name", F.concat(F.lit("us-gaap:"), "tag").alias("tag"), canonical_field(C("tag")).alias("canonical_field"), F.coalesce("f.val", F.lit(0.0)).alias("value"), unit_label(C("unit")).alias("unit"),
        periods.to_date(start_text).alias("period_start"), periods.to_date(end_text).alias("period_end"), start_text.isNotNull().alias("has_start"), C("f.form").alias("form_type"), C("f.fy").alias("fy"), C("f.fp").alias("fp"),
    )
    rows = rows.where("period_end is not null and (not has_start or period_start is not null)")
    rows = rows.withColumns({"duration_days": F.datediff("period_end", "period_start"), "is_instant": ~C("has_start"), "fiscal_period": periods.infer_fiscal_period(C("period_end"), C("form_type"), C("fy"), C("fp"))})
    return rows.where("fiscal_period is not null").drop("has_start", "fy", "fp")


def cik_of(names: DataFrame, landed: DataFrame, key: str = "query", json: str = "json") -> DataFrame:
    """key, cik: exact ticker first, then a title that contains the name or is contained in it, in file order."""
    entries = landed.select(F.posexplode(F.map_values(F.from_json(json, TICKERS))).alias("pos", "e")).select("pos", F.upper("e.ticker").alias("t"), F.lower("e.title").alias("title"), F.lpad(C("e.cik_str").cast("string"), 10, "0").alias("cik"))
    q = names.select(key, F.upper(F.trim(key)).alias("t"))
    exact = q.join(entries.select("t", "cik", F.lit(1).alias("rank"), "pos"), "t").select(key, "rank", "pos", "cik")
    w = F.lower(F.trim(key))
    # a name that stands in a title shares its first three letters (or its first, if it is shorter) with a place of the title, and
    # the other way round: pairs meet by these keys and are then compared, so names never meet all titles
    head = lambda c: F.when(F.length(c) >= 3, F.substring(c, 1, 3)).otherwise(F.substring(c, 1, 1))
    places = lambda c: F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.array(F.substr(c, i, F.lit(3)), F.substr(c, i, F.lit(1)))))))
    rest = names.select(key).join(exact.select(key).distinct(), key, "left_anti").distinct().withColumn("_w", w).where("_w <> ''")
    titles = entries.where("title <> ''").select("title", "cik", "pos")
    inside = rest.withColumn("_k", head(C("_w"))).join(titles.withColumn("_k", places(C("title"))), "_k").where(C("title").contains(C("_w")))
    around = rest.withColumn("_k", places(C("_w"))).join(titles.withColumn("_k", head(C("title"))), "_k").where(C("_w").contains(C("title")))
    fuzzy = inside.select(key, F.lit(2).alias("rank"), "pos", "cik").union(around.select(key, F.lit(2).alias("rank"), "pos", "cik"))
    return exact.union(fuzzy).groupBy(key).agg(F.min_by("cik", F.struct("rank", "pos")).alias("cik"))


def primary_filing(landed: DataFrame, form: str, year: int | None = None, key: str = "cik", json: str = "json") -> DataFrame:
    """The filing of a form group: the first of the year, else the first of all. Landed partitions come as further rows (`part` > 0)."""
    part = C("part") if "part" in landed.columns else F.lit(0)
    r = landed.select(key, part.alias("part"), F.from_json(json, SUBMISSIONS).alias("j"))
    r = r.select(key, "part", C("j.name").alias("company_name"), C("j.filings.recent").alias("r"))
    z = F.arrays_zip("r.form", "r.filingDate", "r.reportDate", "r.accessionNumber", "r.primaryDocument")
    z = r.select(key, "part", "company_name", F.posexplode(z).alias("pos", "z")).select(key, "part", "company_name", "pos", "z.*")
    z = z.where(C("form").isin(*FORM_GROUPS.get(form.upper(), (form.upper(),)))).withColumn("report_date", F.coalesce(F.nullif("reportDate", F.lit("")), C("filingDate")))
    hit = (C("report_date").contains(str(year)) | C("filingDate").contains(str(year))) if year else F.lit(True)
    w = Window.partitionBy(key).orderBy(F.when(hit, 0).otherwise(1), "part", "pos")
    z = z.where(hit | (C("part") == 0)).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return z.select(key, "company_name", "form", C("filingDate").alias("filing_date"), "report_date", F.replace("accessionNumber", F.lit("-"), F.lit("")).alias("accession"), C("primaryDocument").alias("document"))


# ---------------------------------------------------------------- instance documents

_XBRLI = "{http://www.xbrl.org/2003/instance}"
_SPACES = (("us-gaap", "fasb.org/us-gaap/"), ("dei", "xbrl.sec.gov/dei/"), ("ifrs-full", "xbrl.ifrs.org/taxonomy/"))
_INSTANCE = pa.schema([("path", pa.string()), ("tag", pa.string()), ("value", pa.float64()), ("unit", pa.string()), ("period_start", pa.date32()), ("period_end", pa.date32()), ("duration_days", pa.int32()), ("is_instant", pa.bool_()), ("problem", pa.string())])


def _day(e: ET.Element | None) -> date | None:
    try:
        return date.fromisoformat((e.text or "").strip()[:10]) if e is not None else None
    except ValueError:
        return None


def prefix_of(tag: str) -> str:
    """us-gaap, dei, ifrs-full or '' by the namespace, whatever its year."""
    uri = tag[1:].partition("}")[0] if tag.startswith("{") else ""
    return next((n for n, part in _SPACES if uri.split("://", 1)[-1].startswith(part)), "")


def instance_facts(xml: str, market: str = "US") -> list[dict]:
    """Numeric us-gaap and dei facts of consolidated contexts."""
    root = ET.fromstring(xml)
    spans: dict[str, tuple] = {}
    for c in root.iter(f"{_XBRLI}context"):
        p = c.find(f"{_XBRLI}period")
        if p is None or c.find(f"{_XBRLI}entity/{_XBRLI}segment") is not None:
            continue
        at, a, b = (p.find(_XBRLI + n) for n in ("instant", "startDate", "endDate"))
        if at is not None:
            spans[c.get("id", "")] = (None, _day(at), True)
        elif a is not None and b is not None:
            spans[c.get("id", "")] = (_day(a), _day(b), False)
    units: dict[str, str] = {}
    for u in root.iter(f"{_XBRLI}unit"):
        m = [x.text.split(":")[-1] for x in u.iter(f"{_XBRLI}measure") if x.text]
        if m:
            units[u.get("id", "")] = "/".join([m[0], *("share" if x.lower() in ("share", "shares") else x for x in m[1:2])])
    out = []
    for e in root:
        prefix, text = prefix_of(e.tag), (e.text or "").strip()
        if prefix not in ("us-gaap", "dei") or not text or e.get("contextRef", "") not in spans:
            continue
        try:
            value = float(text)
        except ValueError:
            continue
        start, end, instant = spans[e.get("contextRef")]
        days = (end - start).days if start and end else None
        out.append({"tag": f"{prefix}:{e.tag.partition('}')[2]}", "value": value, "unit": units.get(e.get("unitRef", ""), "USD" if market == "US" else "INR"), "period_start": start, "period_end": end, "duration_days": days, "is_instant": instant})
    return out


def instances(landed: DataFrame, market: str = "US", key: str = "path", xml: str = "xml") -> DataFrame:
    """Fact rows of landed instance documents, one document a row; `broken_instances` tells of those that can't be read."""
    df = _instances(landed, market, key, xml).where("problem is null").drop("problem")
    return df.withColumn("canonical_field", canonical_field(C("tag")))


def broken_instances(landed: DataFrame, key: str = "path", xml: str = "xml") -> DataFrame:
    """path, problem of the instance documents that can't be read."""
    return _instances(landed, "US", key, xml).where("problem is not null").select("path", "problem")


def _instances(landed: DataFrame, market: str, key: str, xml: str) -> DataFrame:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [{"path": k} | f for f in instance_facts(x or "", market)]
                except ET.ParseError as e:
                    rows.append({"path": k, "problem": f"broken: {e}"})
            yield pa.RecordBatch.from_pylist(rows, schema=_INSTANCE)

    return landed.select(C(key).alias("path"), C(xml).alias("xml")).mapInArrow(run, "path string, tag string, value double, unit string, period_start date, period_end date, duration_days int, is_instant boolean, problem string")
