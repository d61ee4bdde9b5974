"""Questions to prompts, and answers to their checked parts, for whole tables of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import charts, numbers
from tallyloom.functions import text as X
from tallyloom.operators import facts, retrieval, routing
from tallyloom.session import materialize

C = F.col
#: Gives (query_id, answer) for (query_id, prompt); no model is shipped.
Model = Callable[[DataFrame], DataFrame]


def routed(questions: DataFrame, fact_rows: DataFrame, filings: DataFrame, companies: DataFrame) -> DataFrame:
    """query_id, question, ticker, fiscal_period, numeric and abstain (a category, null for questions to answer)."""
    scope = routing.resolve_scope(questions, companies)
    joined = facts.with_filings(fact_rows, filings, companies)
    latest = joined.groupBy("ticker").agg(F.max("period_end").alias("latest_end"))
    every = fact_rows.agg(F.max("period_end").alias("overall_end"))  # one row
    q = questions.select("query_id", "question").join(scope, "query_id").join(latest, "ticker", "left").crossJoin(F.broadcast(every))
    end = F.when(C("ticker").isNull(), C("overall_end")).otherwise(C("latest_end"))
    return q.select("query_id", "question", "ticker", "fiscal_period", routing.wants_number(C("question")).alias("numeric"), routing.abstention(C("question"), end).alias("abstain"))


def prompts(route: DataFrame, blocks: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """query_id, prompt: the facts block first, then the numbered sources, then the question.

    Questions to abstain from have none. blocks: `facts.context_block`; hits:
    retrieved chunks with query_id and rank.
    """
    r = route.where("abstain is null").join(blocks, ["ticker", "fiscal_period"], "left")
    if hits is not None:
        r = r.join(retrieval.format_context(hits, "query_id"), "query_id", "left")
    else:
        r = r.withColumn("context", F.lit(None).cast("string"))
    return r.select("query_id", F.concat_ws("\n\n", "block", F.concat(F.lit("Context:\n"), "context"), F.concat(F.lit("Question: "), "question")).alias("prompt"))


def hits_of(questions: DataFrame, chunks: DataFrame, k: int = 3, *, key: str = "id") -> DataFrame:
    """query_id, rank, similarity and the chunk of the k most similar chunks of every question (query_id, ticker, fiscal_period, vector).

    A question with a ticker looks at this company's chunks: those of its
    period if there are any, else all. Others look at all chunks. Company and
    question meet by an equi-join; only keys and scores are ranked, and the
    chunks of the k best are joined at the end.
    """
    own = questions.where("ticker is not null").select("query_id", "ticker", C("fiscal_period").alias("_period"), "vector")
    near = chunks.select(key, "ticker", "fiscal_period", "embedding").join(own, "ticker").withColumn("similarity", numbers.cosine(C("embedding"), C("vector"))).where("similarity is not null")
    rung = F.when(C("fiscal_period") == C("_period"), 0).otherwise(1)
    near = near.select("query_id", key, "similarity", rung.alias("_rung"))
    order = ["_rung", C("similarity").desc(), C(key).asc()]
    salted = near.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(16)))
    salted = salted.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "_salt").orderBy(*order))).where(C("_n") <= k)
    best = salted.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).withColumn("_least", F.min("_rung").over(Window.partitionBy("query_id")))
    best = best.where((C("_n") <= k) & (C("_rung") == C("_least"))).select("query_id", key, C("_n").alias("rank"), "similarity")
    rest = questions.where("ticker is null").select("query_id", "vector")
    every = retrieval.top_k_of_each(chunks, rest, k, key=key).select("query_id", key, "rank", "similarity")
    return best.unionByName(every).join(chunks.drop("embedding", "similarity"), key)


def generated(questions: DataFrame, chunks: DataFrame, fact_rows: DataFrame, filings: DataFrame, companies: DataFrame, models: list[Model], *, k: int = 3) -> DataFrame:
    """Questions (query_id, question, vector) to answers: query_id, abstain, answer, model_no, text, chart, chart_grounded.

    Routing and abstention, facts and sources, prompts, the models in turn,
    and the parts of the answer. Questions to abstain from get no prompt and no
    answer.
    """
    route = materialize(routed(questions, fact_rows, filings, companies), "answers-route")
    asked = route.where("abstain is null").join(questions.select("query_id", "vector"), "query_id")
    best = facts.best_fact(facts.reported(facts.with_filings(fact_rows, filings, companies)))
    said = materialize(answered(prompts(route, facts.context_block(best, companies), hits_of(asked, chunks, k)), models), "answers-said")
    parts = finished(said.join(route.select("query_id", "ticker"), "query_id").select("query_id", "ticker", "answer"), best)
    return route.select("query_id", "abstain").join(said, "query_id", "left").join(parts, "query_id", "left")


#: What a standard report asks for; the instruction of `report_prompts` if none is given.
REPORT = "Write a report on this filing: what the company does, its results against the year before, its cash flows and debt, its risks, and what the filing leaves open. Cite the numbered sources."


def report_prompts(papers: DataFrame, chunks: DataFrame, k: int = 6, instruction: str = REPORT) -> DataFrame:
    """paper_id, prompt: the instruction with the k chunks of each document that are most similar to the document's vector (paper_id, vector)."""
    near = chunks.join(papers.select("paper_id", "vector"), "paper_id").withColumn("similarity", numbers.cosine(C("embedding"), C("vector"))).where("similarity is not null")
    hits = near.withColumn("rank", F.row_number().over(Window.partitionBy("paper_id").orderBy(C("similarity").desc(), C("id").asc()))).where(C("rank") <= k)
    context = retrieval.format_context(hits.withColumn("_of", C("paper_id")), "_of").withColumnRenamed("_of", "paper_id")
    return papers.select("paper_id").join(context, "paper_id", "left").select("paper_id", F.concat_ws("\n\n", F.concat(F.lit("Context:\n"), "context"), F.lit(instruction)).alias("prompt"))


def answered(asked: DataFrame, models: list[Model]) -> DataFrame:
    """query_id, answer, model_no of the first model with an answer that isn't blank; prompts that none answers get null.

    Each model only sees what the earlier ones left. Its answers are written
    before the next one runs, so no model is called twice for a prompt.
    """
    left, out = asked.select("query_id", "prompt"), None
    for n, model in enumerate(models, 1):
        got = model(left).where(F.trim(F.coalesce("answer", F.lit(""))) != "").select("query_id", "answer", F.lit(n).alias("model_no"))
        got = materialize(got, "answers")
        out = got if out is None else out.unionByName(got)
        left = left.join(got.select("query_id"), "query_id", "left_anti")
    rest = left.select("query_id", F.lit(None).cast("string").alias("answer"), F.lit(None).cast("int").alias("model_no"))
    return rest if out is None else out.unionByName(rest)


def finished(answers: DataFrame, periods_of: DataFrame) -> DataFrame:
    """query_id, text, chart, chart_grounded from (query_id, ticker, answer); periods_of: ticker, fiscal_period."""
    known = periods_of.groupBy("ticker").agg(F.collect_set("fiscal_period").alias("_p"))
    a = answers.join(known, "ticker", "left").withColumn("chart", charts.extract(C("answer")))
    ok = C("chart").isNotNull() & C("_p").isNotNull() & F.coalesce(charts.grounded(C("chart.x"), C("_p")), F.lit(False))
    return a.select("query_id", X.visible_answer(C("answer")).alias("text"), "chart", ok.alias("chart_grounded"))
