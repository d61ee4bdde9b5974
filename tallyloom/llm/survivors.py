"""Problem 5: one surviving row per reported quantity.

`quantities` groups facts without any group in one task: links are found
between the distinct (company, field, period end, length) combinations, not
between facts, their components by alternating stars, and the survivors are
partial aggregates.

Two rules choose the survivors. `latest_survivors` takes each field from the
latest filing that fills it, which is the rule that TESTDATA.md fixes and
which no reliability weighting can give. `truth_discovery` is the named
method: source reliabilities and weighted votes are estimated in turn until
they settle, and the value with the highest support survives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import components
from tallyloom.session import materialize

DAYS_APART = 7
LENGTH_APART = 12
FIELDS = ("value", "unit", "period_start", "period_end", "duration_days", "source_page")
#: Texts that stand for nothing, in lower case; texts without any letter or digit do as well.
NOTHING = ("n/a", "na", "n.a.", "nan", "none", "null", "nil", "tbd", "tba", "unknown", "undefined", "missing", "not available", "not applicable", "unspecified", "empty", "void", "#n/a", "(none)", "(blank)", "(empty)", "(null)")


def filled(c: Column, kind: str) -> Column:
    """Neither null nor NaN nor a text that stands for nothing."""
    if kind == "string":
        t = F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
        return c.isNotNull() & t.rlike(r"[\p{L}\p{Nd}]") & ~t.isin(*NOTHING)
    if kind in ("double", "float"):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def field_key(c: Column) -> Column:
    """A field name whatever its case and separators."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]+", "")


def linked(combinations: DataFrame) -> DataFrame:
    """id, root: combinations (id, company_id, field, is_point, end_day, length) by the smallest id that chains of admissible pairs reach.

    Two combinations of one company, field and kind are admissible if their
    ends lie at most DAYS_APART days and their lengths at most LENGTH_APART
    days apart. Only pairs that can make a difference are joined: cells of one
    end and length band hold combinations that all admit each other, so each
    points to its cell's smallest, and cells meet their neighbours by an
    equi-join on ends and bands.
    """
    key = ["company_id", "field", "is_point"]
    band = combinations.withColumn("band", F.floor(F.col("length") / (LENGTH_APART + 1)))
    # those of one end in one band admit each other
    cell = band.groupBy(*key, "end_day", "band").agg(F.min("id").alias("cell"))
    inside = band.join(cell, [*key, "end_day", "band"])
    star = inside.where("id <> cell").select(F.col("id").alias("u"), F.col("cell").alias("v"))
    # others are reached within the days and the next band; lengths are compared one by one only there
    near = F.explode(F.expr(f"flatten(transform(sequence(0, {DAYS_APART}), d -> transform(sequence(-1, 1), b -> struct(end_day + d as end_day, band + b as band))))")).alias("n")
    l = inside.select(*key, F.col("id").alias("u"), F.col("length").alias("lu"), F.col("cell").alias("cu"), near).select(*key, "u", "lu", "cu", "n.end_day", "n.band")
    r = inside.select(*key, "end_day", "band", F.col("id").alias("v"), F.col("length").alias("lv"), F.col("cell").alias("cv"))
    meets = l.join(r, [*key, "end_day", "band"]).where((F.col("cu") != F.col("cv")) & (F.abs(F.col("lu") - F.col("lv")) <= LENGTH_APART))
    root = components(star.union(meets.select(F.col("cu").alias("u"), F.col("cv").alias("v"))))
    return combinations.select("id").join(root.select(F.col("node").alias("id"), "root"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def quantities(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """The facts that are in a group, with group_id, company_id, filed_date and field.

    Facts of one company and field belong together if their period ends are at
    most DAYS_APART days apart and both are points in time or their lengths
    differ by at most LENGTH_APART days; chains of such pairs form one group.
    Left out are facts without a period end, field, id or known company, and
    groups of one fact. A fact delivered twice counts once.
    """
    f = facts.select("fact_id", "filing_id", "canonical_field", *FIELDS).where("fact_id is not null and period_end is not null")
    own = filings.select("filing_id", "company_id", "filed_date").where("company_id is not null").dropDuplicates(["filing_id"])
    f = f.join(own, "filing_id").withColumn("field", field_key(F.col("canonical_field"))).where("field <> ''")
    length = F.coalesce("duration_days", F.datediff("period_end", "period_start"))
    f = f.withColumn("is_point", length.isNull()).withColumn("length", F.coalesce(length, F.lit(0))).withColumn("end_day", F.unix_date("period_end"))
    key = ["company_id", "field", "is_point", "end_day", "length"]
    f = materialize(f, "p5-facts")
    c = materialize(f.groupBy(*key).agg(F.min("fact_id").alias("id")), "p5-combinations")
    at = materialize(c.join(linked(c), "id").select(*key, "root"), "p5-roots")
    f = f.join(at, key)
    ids = f.groupBy("root").agg(F.min("fact_id").alias("group_id"), F.max("fact_id").alias("_last")).where("group_id <> _last").drop("_last")
    return f.join(ids, "root").drop("is_point", "length", "end_day", "root")


def latest_survivors(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """group_id, field_name, fact_id: the fact each field of a group survives from.

    Among the facts where the field is filled: the latest filed_date (null is
    the oldest), then the largest filing_id, then the largest fact_id.
    """
    q = quantities(facts, filings)
    kinds = dict(q.dtypes)
    best = [F.max(F.when(filled(F.col(n), kinds[n]), F.struct("filed_date", "filing_id", "fact_id"))).getField("fact_id").alias(n) for n in FIELDS]
    wide = q.groupBy("group_id").agg(*best)
    return wide.unpivot("group_id", list(FIELDS), "field_name", "fact_id").where("fact_id is not null")


def truth_discovery(facts: DataFrame, filings: DataFrame, *, rounds: int = 200, settled: float = 1e-3, every: int = 4) -> tuple[DataFrame, DataFrame]:
    """Survivors (group_id, field_name, claim, value, support, claims, fact_id) and sources (filing_id, reliability).

    A filing is a source. It claims the text of each filled field of a group;
    values that agree to six significant digits, and texts that agree without
    case and blanks, are one claim. Support of a value is its sources' summed
    reliability as a share of the group's; a source's reliability is the mean
    support of its claims, with one claim of 0.5 added so that small sources
    stay near the middle. Rounds end when no reliability moves by more than
    `settled`, which is looked at `every` rounds; if that doesn't come within
    `rounds`, an error is raised. Equal support falls to the value of the
    latest filing.
    """
    q = quantities(facts, filings)
    kinds = dict(q.dtypes)

    def text(n: str) -> Column:
        c = F.col(n)
        if kinds[n] == "double":
            scale = F.floor(F.log10(F.abs(c))) - 5
            return F.when(c == 0, "0").otherwise(F.concat(F.round(c / F.pow(F.lit(10.0), scale)).cast("long").cast("string"), F.lit("e"), scale.cast("string")))
        return F.lower(F.trim(F.regexp_replace(c.cast("string"), r"(?U)\s+", " ")))

    claims = q.select("group_id", "filing_id", "fact_id", "filed_date", F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), F.when(filled(F.col(n), kinds[n]), text(n)).alias("claim"), F.col(n).cast("string").alias("value")) for n in FIELDS])).alias("x"))
    claims = materialize(claims.select("group_id", "filing_id", "fact_id", "filed_date", "x.*").where("claim is not null"), "p5-claims")
    slot = ["group_id", "field_name"]
    # one vote a source and claim
    votes = materialize(claims.select(*slot, "claim", "filing_id").distinct(), "p5-votes")
    trust = materialize(votes.select("filing_id").distinct().withColumn("reliability", F.lit(0.5)), "p5-trust")
    for k in range(1, rounds + 1):
        share = votes.join(trust, "filing_id").groupBy(*slot, "claim").agg(F.sum("reliability").alias("w"))
        total = share.groupBy(*slot).agg(F.sum("w").alias("all"))
        support = share.join(total, slot).select(*slot, "claim", (F.col("w") / F.col("all")).alias("support"))
        moved = votes.join(support, [*slot, "claim"]).groupBy("filing_id").agg(F.round((F.sum("support") + 0.5) / (F.count(F.lit(1)) + 1), 9).alias("new"))
        nxt = moved.join(trust, "filing_id").select("filing_id", F.col("new").alias("reliability"), F.abs(F.col("new") - F.col("reliability")).alias("step"))
        if k % every:  # a plan of some rounds is run at once
            trust = nxt.select("filing_id", "reliability")
            continue
        nxt = materialize(nxt, f"p5-trust{k}")
        step = nxt.agg(F.max("step")).first()[0]
        trust = nxt.select("filing_id", "reliability")
        if step is None or step <= settled:
            break
    else:
        raise RuntimeError(f"reliabilities did not settle in {rounds} rounds")
    w = claims.select(*slot, "claim", "filing_id").distinct().join(trust, "filing_id").groupBy(*slot, "claim").agg(F.sum("reliability").alias("w"))
    last = claims.groupBy(*slot, "claim").agg(F.max(F.struct("filed_date", "filing_id", "fact_id", "value")).alias("last"), F.count_distinct("filing_id").alias("claims"))
    best = w.join(last, [*slot, "claim"]).groupBy(*slot).agg(F.max(F.struct(F.round("w", 9).alias("w"), "last", "claims", "claim")).alias("b"), F.sum("w").alias("all"))
    out = best.select(*slot, F.col("b.claim").alias("claim"), F.col("b.last.value").alias("value"), F.round(F.col("b.w") / F.col("all"), 6).alias("support"), F.col("b.claims").alias("claims"), F.col("b.last.fact_id").alias("fact_id"))
    return out, trust
