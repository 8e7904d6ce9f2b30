"""Many questions per record as feature columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semframe.functions.templates import Spec, has_placeholder, rewrite_placeholders, template
from semframe.plans.judge import Ask, Judge, cleaned

FAILED = "-"


def ask_of(spec: Spec, about: dict, context: dict[str, str] | None = None) -> Ask:
    if spec.kind == "noul":
        q = template(spec.question)
    else:
        q = rewrite_placeholders(spec.question) if has_placeholder(spec.question) else f"Regarding `text`: {spec.question}"
    return Ask(spec.kind, q, about, options=spec.options, levels=spec.levels, context=context or {})


def sem_probe(df: DataFrame, judge: Judge, specs: Sequence[Spec], *, text: str = "text", scores: bool = False, context: dict[str, str] | None = None) -> DataFrame:
    """A column per question: yes/no its probability, score its position, choice its option; with ``scores`` also ``name.conf``
    for choices and scores.  ``errors`` maps the questions that failed to the reason; their columns are null."""
    clash = {s.name for s in specs} & set(df.columns)
    if clash:
        raise ValueError(f"columns of the input and questions share a name: {', '.join(sorted(clash))}")
    about = {"text": F.coalesce(cleaned(df, text), F.lit(""))}
    out = judge.attach_all(df, {f"_a{i}": ask_of(s, about, context) for i, s in enumerate(specs)})
    errors = []
    for i, s in enumerate(specs):
        a = F.col(f"_a{i}")
        out = out.withColumn(s.name, {"noul": a["noul"], "choice": a["choice"], "score": a["score"]}[s.kind])
        if scores and s.kind != "noul":
            out = out.withColumn(f"{s.name}.conf", a["confidence"])
        errors.append(F.struct(F.lit(s.name).alias("key"), a["error"].alias("value")))
    failed = F.map_from_entries(F.filter(F.array(*errors), lambda e: e["value"].isNotNull()))
    return out.withColumn("errors", F.when(F.size(failed) > 0, failed)).drop(*[f"_a{i}" for i in range(len(specs))])


def as_json(probed: DataFrame, specs: Sequence[Spec], text: str = "text", parsed: bool = False) -> DataFrame:
    """``json``: ``{record, answers}`` with the answers in question order; ``parsed`` embeds a JSON record as it is."""
    answers = F.to_json(F.struct(*[F.col(f"`{s.name}`").alias(s.name) for s in specs]), {"ignoreNullFields": "false"})
    record = F.col(text) if parsed else F.to_json(F.struct(F.col(text).alias("record")))
    if not parsed:
        record = F.expr("substring(_r, 11, length(_r) - 11)")
        return probed.withColumn("_r", F.to_json(F.struct(F.coalesce(F.col(text), F.lit("")).alias("record")))).withColumn(
            "json", F.concat(F.lit('{"record":'), record, F.lit(',"answers":'), answers, F.lit("}"))).drop("_r")
    return probed.withColumn("json", F.concat(F.lit('{"record":'), record, F.lit(',"answers":'), answers, F.lit("}")))
