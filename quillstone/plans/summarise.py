"""Summaries by a model, with retries as rounds over a table: each round asks for the batches that are still open, and is written before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import fixed
from quillstone.functions import text as t
from quillstone.operators import calls
from quillstone.operators.evidence import check_response
from quillstone.sources.boundary import written

#: A model: a request {batch_id, attempt (from 0), prompt, num_ctx, num_predict} -> its server's answer {response, done, done_reason, prompt_eval_count}.
#: It raises one of calls.FAILURES with the server's message where it fails; some messages say that the input is over the context.
Model = Callable[[dict], dict]

_ANSWER = "struct<outcome:string,error:string,sentences:array<struct<text:string,evidence:array<string>>>,uncertainties:array<string>,words:int,counted:long>"
SUMMARIES = "batch_id, error, sentences, uncertainties, words, attempts (num_ctx, num_predict, outcome)"


def _judge(answer: dict, known: set[str]) -> dict:
    """An answer as the type of _ANSWER: incomplete, of a wrong format, or complete."""
    count = answer.get("prompt_eval_count")
    out = {"outcome": "incomplete", "error": None, "sentences": None, "uncertainties": None, "words": None, "counted": count if type(count) is int and count > 0 else 0}
    if answer.get("done") is not False and answer.get("done_reason") != "length":
        error, sentences, notes, words = check_response(answer.get("response", ""), known)
        out |= {"outcome": "invalid_format" if error else "complete", "error": error, "sentences": sentences, "uncertainties": notes, "words": words}
    return out


def _planned(rows: DataFrame, fixed_bytes: int, shorter: str, repair: str) -> DataFrame:
    """Open batches with the request of their next attempt: the budget of their level, and the first context from their level on that holds the estimate."""
    budgets = F.array(*map(F.lit, fixed.OUTPUT_BUDGETS))
    again = (F.col("output") > 0) | (F.col("repairs") > 0)
    size = F.octet_length("prompt") + fixed_bytes + F.when(again, len(shorter.encode())).otherwise(0) + F.when(F.col("repairs") > 0, len(repair.encode())).otherwise(0)
    rows = rows.withColumns({"num_predict": F.get(budgets, F.col("output")), "_size": size})
    needed = F.col("num_predict") + fixed.RESERVE_TOKENS + F.greatest(F.ceil(F.col("_size") / 3), F.col("counted"))
    small = F.size(F.filter(F.slice("contexts", F.col("context") + 1, F.size("contexts")), lambda c: c < needed))
    rows = rows.withColumn("context", F.least(F.size("contexts") - 1, F.col("context") + small))
    asked = F.concat("prompt", F.when(again, shorter).otherwise(""), F.when(F.col("repairs") > 0, repair).otherwise(""))
    return rows.withColumns({"num_ctx": F.get("contexts", F.col("context")), "prompt": asked}).drop("_size")


_STATE = ("context", "output", "repairs", "counted")
#: Characters of prompts, in bytes, that a partition of their join has on average.
PART_BYTES = 64 << 20


def _with_prompts(state: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """Open batches with their prompts, joined in `parts` partitions: prompts that compress well would be gathered into few by their compressed size, and sorted at their full size."""
    return state.repartition(parts, "batch_id").join(texts.repartition(parts, "batch_id").hint("merge"), "batch_id")


def summaries(prompts: DataFrame, model: Model, contexts: Column, system: str = "", schema: str = "", shorter: str = "", repair: str = "", **options) -> DataFrame:
    """SUMMARIES of prompts (batch_id, prompt, known: ids of units that may be cited): one row for each batch.

    `contexts`, an array of sizes in rising order, are those to try (planning.context_plan). An answer that broke off raises the output budget, a refusal
    or an estimate over the context the context, a wrong format allows one repair; what is raised at its top ends the batch with an error. Nothing is
    trimmed, and no partial answer is kept. A batch's attempts are bounded by these levels, so the rounds are by their sum. Batches that are done are asked for no more;
    any other failure of the model ends its batch alone. `options` are those of calls.ask. batch_ids are distinct; no prompts, no calls.
    """
    texts = written(prompts.select("batch_id", "prompt", "known", contexts.cast("array<int>").alias("contexts")), "prompts", options.get("progress"), prompts=F.count(F.lit(1)))
    sizes = texts.agg(F.max(F.size("contexts")), F.sum(F.octet_length("prompt")).cast("long")).first()
    most, parts = (sizes[0] or 1) - 1 + len(fixed.OUTPUT_BUDGETS) - 1 + 1, max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(sizes[1] or 0) // PART_BYTES))

    def call(row: dict) -> dict:
        try:
            return _judge(model({k: row[k] for k in ("batch_id", "attempt", "prompt", "num_ctx", "num_predict")}), set(row["known"] or ()))
        except calls.FAILURES as e:
            if not _overflows(str(e)):
                raise
            return {"outcome": "context_overflow", "error": None, "sentences": None, "uncertainties": None, "words": None, "counted": 0}

    attempt = "array<struct<num_ctx:int,num_predict:int,outcome:string>>"
    start = ("batch_id", *(F.lit(0).cast("long" if c == "counted" else "int").alias(c) for c in _STATE), F.array().cast(attempt).alias("attempts"))
    state = done = None
    for turn in range(1 + most):
        asked = texts.where("batch_id IS NOT NULL").repartition(parts, "batch_id").select(*start, "prompt", "known", "contexts") if state is None else _with_prompts(state, texts, parts)
        rows = _planned(asked, len((system + schema).encode()), shorter, repair).withColumn("attempt", F.lit(turn))
        told = calls.ask(rows, call, _ANSWER, name=f"summaries-{turn}", keep=["batch_id", *_STATE, "attempts", "num_ctx", "num_predict", "contexts"], **options)
        outcome = F.coalesce("answer.outcome", F.lit("failed"))
        told = told.withColumn("attempts", F.concat("attempts", F.array(F.struct("num_ctx", "num_predict", outcome.alias("outcome"))))).withColumn("_outcome", outcome)
        top = {"context_overflow": F.col("context") >= F.size("contexts") - 1, "incomplete": F.col("output") >= len(fixed.OUTPUT_BUDGETS) - 1, "invalid_format": F.col("repairs") >= 1}
        error = (
            F.when(F.col("_outcome") == "failed", F.col("error")).when((F.col("_outcome") == "context_overflow") & top["context_overflow"], fixed.DOES_NOT_FIT)
            .when((F.col("_outcome") == "incomplete") & top["incomplete"], fixed.STOPPED_EARLY).when((F.col("_outcome") == "invalid_format") & top["invalid_format"], F.col("answer.error"))
        )
        told = told.withColumn("_error", error)
        over = told.where("_error IS NOT NULL OR _outcome = 'complete'")
        kept = lambda c: F.when(F.col("_error").isNull(), F.col(f"answer.{c}")).alias(c)
        over = over.select("batch_id", F.col("_error").alias("error"), kept("sentences"), kept("uncertainties"), kept("words"), "attempts")
        done = over if done is None else done.unionByName(over)
        raised = {"context": "context_overflow", "output": "incomplete", "repairs": "invalid_format"}
        levels = {c: (F.col(c) + (F.col("_outcome") == o).cast("int")).alias(c) for c, o in raised.items()}
        state = told.where("_error IS NULL AND _outcome != 'complete'").select("batch_id", *levels.values(), F.greatest("counted", F.coalesce("answer.counted", F.lit(0))).alias("counted"), "attempts")
        if state.isEmpty():
            break
    return done


def _overflows(message: str) -> bool:
    """The rule of functions.text.is_overflow on one message, where it arises."""
    return any(phrase in message[:500].lower() for phrase in fixed.OVERFLOW_PHRASES)


def check_runtimes(models: DataFrame, probe: Callable[[str], dict], **options) -> DataFrame:
    """model, version, model_context, error for each different model of a table (model): what its runtime says, asked for once.

    probe gives {version, context}. A version under the oldest that will do, or a context that isn't a whole number of LEAST_CONTEXT at least, is an error.
    """

    def call(row: dict) -> dict:
        told = probe(row["model"])
        context = told.get("context")
        return {"version": str(told.get("version", "")), "context": context if type(context) is int else None}

    told = calls.ask(models.select("model").where("model IS NOT NULL").distinct(), call, "struct<version:string,context:long>", name="runtimes", **options)
    old = ~t.compatible_version(F.col("answer.version"))
    blind = ~F.coalesce(F.col("answer.context") >= fixed.LEAST_CONTEXT, F.lit(False))
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(old, fixed.RUNTIME_TOO_OLD).when(blind, fixed.NO_CONTEXT)
    return told.select("model", F.col("answer.version").alias("version"), F.when(~blind, F.col("answer.context")).alias("model_context"), error.alias("error"))
