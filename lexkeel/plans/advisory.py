"""Advisory rules: what a model is shown, what it may answer, and how its quotes are checked.

A rule's specification is data. Planning is relational: sections by role, chunks of those sections, the first and last of each,
a total limit, picked for each rule from one row a document. No model is called here: a provider is a function of rows, the ones that ship are ``disabled`` and
``annotated`` (answers from a table). An answer never fails a rule, and a quote counts only if it stands in a chunk that was shown.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identity import locator
from ..functions.text import nfc

#: Rule, roles, elements, chunks of a section, chunks in all, flags (a: all roles needed, h: headings only).
SPECS = """
ALG-01 algorithm representation_type,topic_fit,step_sequence 2 6 -
ALG-03 algorithm numbered_blocks,textual_descriptions,one_to_one_coverage 2 6 -
ANN-01 annotation object_problem,relevance,goal,tasks,results,structure 2 6 -
ARC-01 system_analysis,architecture as_is_basis,to_be_model,change_rationale,model_traceability 2 4 a
ARC-02 task,architecture requirements_traceability,implementation_stack,environment_interaction,satisfaction_methods 2 4 a
TSK-01 task analysis_summary,goal,tasks,expected_result 2 6 -
TSK-03 task,results measurable_goal,quantitative_results,goal_result_alignment 2 6 -
CON-01 task,conclusion task_results,key_result,quantitative_goal_assessment 2 6 -
IMP-01 architecture,implementation,results stack_sequence,testing_order,datasets,intermediate_results 2 6 a
INT-01 introduction object_location,importance,object_problems,relevance,existing_solutions,solution_need 2 6 -
MTH-02 math_model symbolic_inputs,general_form,variable_explanations,formula_explanations,no_numeric_substitution 2 6 -
MTH-03 task,math_model,results metric_definitions,calculation_methods,goal_indicators,cross_section_traceability 2 6 a
RES-01 task,results task_evaluation,final_metrics,metric_interpretation,criteria_alignment,quantitative_goal_assessment,object_problem_resolution,limitations,result_summary 3 6 a
REV-02 review foreign_publication_metadata,peer_review_evidence,minimum_count_basis 3 3 -
REV-04 review source_type_metadata,prohibited_type_assessment,publication_status 3 3 -
REV-05 review comparison,synthesis,classification,thematic_structure 3 3 -
REV-06 review background_state,review_questions,selection_method,metadata_analysis,comparative_analysis,answers,method_choice_conclusion 3 3 -
SSA-01 system_analysis as_is_model_description,notation,diagram_reference 3 3 -
SSA-02 task,system_analysis software_applicability,environment,integration_system,integration_address,integration_protocol_api 2 4 a
SSA-03 task,system_analysis computational_applicability,data_attribute,data_kind,data_format,data_frequency,measurement_unit,data_example 2 4 a
SSA-04 system_analysis as_is_description,current_problems,preproject_boundary 2 6 -
TSK-02 task contextualized_actions,method_detail,expected_outputs 2 6 -
GEN-01 content section_handoffs,causal_chain 1 12 -
GEN-02 content audience_context,reproducible_method,input_parameters,result_interpretation 1 12 -
STR-05 subsection_headings conciseness,thematic_focus,no_source_by_source_heading 1 20 h
"""
ALIASES = {
    "annotation": ["аннотац", "реферат", "abstract"], "introduction": ["введен", "introduction"], "conclusion": ["заключен", "вывод", "conclusion"],
    "task": ["постановка задач", "цель и задач", "цели и задач", "problem statement", "objectives"], "review": ["обзор нти", "обзор научно технической", "литературный обзор", "literature review", "related work"],
    "system_analysis": ["структурный системный анализ", "системный анализ", "модель as is", "as is model"], "math_model": ["математическая модель", "математическое моделирование", "math model", "mathematical model"],
    "algorithm": ["алгоритм", "algorithm", "псевдокод", "pseudocode"], "architecture": ["архитектурно техническое решение", "архитектурное решение", "архитектура", "модель to be", "to be model", "architecture"],
    "implementation": ["программная реализация", "реализация", "implementation", "software implementation"], "results": ["анализ результат", "результат", "оценка эффективност", "апробац", "results", "evaluation"],
}
NO_CONTENT = ["библиограф", "список использованных источников", "список литературы", "references", "приложен", "appendix"]
QUOTE_CHARS, QUOTE_WORDS = 64, 10


def specs(spark: SparkSession) -> DataFrame:
    rows = [(r, roles.split(","), elements.split(","), int(a), int(b), "a" in f, "h" in f) for r, roles, elements, a, b, f in (line.split() for line in SPECS.strip().splitlines())]
    return spark.createDataFrame(rows, "rule_id string, roles array<string>, elements array<string>, per_section int, in_all int, all_roles boolean, headings_only boolean")


def has_role(norm: Column, kind: Column, level: Column, role: str) -> Column:
    """Whether a section (by plain title, kind and level) plays a role."""
    none = ~F.greatest(*[F.contains(norm, F.lit(a)).cast("int") for a in NO_CONTENT]).cast("boolean")
    if role == "subsection_headings":
        return (level >= 2) & none
    if role == "content":
        return ~kind.isin("annotation", "appendix", "document") & none
    named = F.lit(False)
    for a in ALIASES.get(role, [role]):
        named = named | F.contains(norm, F.lit(a))
    return (kind == role) | named if role in ("annotation", "introduction", "conclusion") else named


def plan(spark: SparkSession, sections: DataFrame, chunks: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """What each rule is shown of each document: ``doc_id``, ``rule_id``, ``chunks`` (id, text, start), ``missing_roles``, ``state``.

    ``sections`` (``doc_id``, ``section_id``, ``norm``, ``kind``, ``level``, ``char_start``); ``chunks`` (``doc_id``, ``section_id``, ``chunk_id``, ``text``,
    ``char_start``); ``hidden``: chunk ids that touch service pages. Specifications are a fixed, small table: one projection tags each section with its roles.
    """
    table = specs(spark)
    roles = sorted({r for line in SPECS.strip().splitlines() for r in line.split()[1].split(",")})
    tagged = sections.withColumn("roles_held", F.array_compact(F.array(*[F.when(has_role(F.col("norm"), F.col("kind"), F.col("level"), r), r) for r in roles])))
    filled = chunks.where(F.trim("text") != "").select("doc_id", "section_id").distinct()
    tagged = tagged.join(filled, ["doc_id", "section_id"], "left_semi").where(F.size("roles_held") > 0)
    # A section's roles, once however many rows tell of it.
    held = tagged.groupBy("doc_id", "section_id").agg(F.array_distinct(F.flatten(F.collect_list("roles_held"))).alias("roles_held"))
    shown = (chunks if hidden is None else chunks.join(hidden, ["doc_id", "chunk_id"], "left_anti")).select("doc_id", "section_id", "chunk_id", "text", "char_start", F.lit(False).alias("heading"))
    # Only what some rule can show goes on: the first and the last of each section, the first one more of an odd number.
    most = max(int(line.split()[3]) for line in SPECS.strip().splitlines())
    ends = _ends(shown, most).join(held, ["doc_id", "section_id"])
    if "title" in sections.columns:
        # Rules over headings see the title of each section and none of its text.
        heads = sections.select("doc_id", "section_id", F.concat(F.lit("heading:"), F.substring(F.sha2("title", 256), 1, 16)).alias("chunk_id"), F.col("title").alias("text"), "char_start", F.lit(True).alias("heading"))
        ends = ends.unionByName(_ends(heads, most).join(held, ["doc_id", "section_id"]))
    piece = F.struct("char_start", "chunk_id", "heading", "at", "back", "roles_held", "text")
    pieces = ends.groupBy("doc_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    played = held.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("roles_held"))).alias("played"))
    every = sections.select("doc_id").distinct().join(played, "doc_id", "left").join(pieces, "doc_id", "left")
    # Each rule picks from a document's pieces in its row: texts are neither joined, sorted nor shuffled for every rule.
    out = every.join(F.broadcast(table), F.expr("true"))
    wanted = lambda c: F.arrays_overlap(c["roles_held"], F.col("roles")) & ((c["at"] <= F.ceil(F.col("per_section") / 2)) | (c["back"] <= F.floor(F.col("per_section") / 2)))
    if "title" in sections.columns:
        chosen = F.filter("pieces", lambda c: (c["heading"] == F.col("headings_only")) & wanted(c))
    else:
        chosen = F.filter("pieces", wanted)
    packed = F.transform(F.slice(chosen, F.lit(1), F.col("in_all")), lambda c, i: F.struct((i + 1).alias("n"), c["chunk_id"].alias("chunk_id"), c["text"].alias("text"), c["char_start"].alias("char_start")))
    missing = F.when(F.col("all_roles"), F.array_sort(F.array_except("roles", F.coalesce("played", F.array().cast("array<string>"))))).otherwise(F.array().cast("array<string>"))
    out = out.select("doc_id", "rule_id", "elements", packed.alias("chunks"), missing.alias("missing_roles"))
    state = F.when(F.coalesce(F.size("chunks"), F.lit(0)) <= 0, "section_missing").when(F.size("missing_roles") > 0, "section_missing").otherwise("ready")
    return out.select("doc_id", "rule_id", "elements", F.when(F.size("chunks") > 0, F.col("chunks")).alias("chunks"), "missing_roles", state.alias("state"))


def _ends(pieces: DataFrame, limit: int) -> DataFrame:
    """The first and the last of each section, ``limit`` at most, with their place from the start (``at``) and from the end (``back``)."""
    own = Window.partitionBy("doc_id", "section_id")
    at = F.row_number().over(own.orderBy("char_start", "chunk_id"))
    placed = pieces.withColumns({"at": at, "back": F.count(F.lit(1)).over(own) - at + 1})
    return placed.where((F.col("at") <= (limit + 1) // 2) | (F.col("back") <= limit // 2))


def verify(quotes: DataFrame, shown: DataFrame) -> DataFrame:
    """Quotes (``doc_id``, ``rule_id``, ``pos``, ``chunk_id``, ``quote``) against the chunks shown: ``error`` is null for a quote that stands, with its ``locator``.

    ``shown`` has ``doc_id``, ``rule_id``, ``chunk_id``, ``text``, ``char_start``, ``digest``. A repeated quote of a chunk is a duplicate, however its letters are composed.
    """
    composed = quotes.withColumn("nfc", nfc(F.col("quote")))
    again = F.row_number().over(Window.partitionBy("doc_id", "rule_id", "chunk_id", "nfc").orderBy("pos")) > 1
    out = composed.withColumn("again", again).join(shown, ["doc_id", "rule_id", "chunk_id"], "left")
    # Sources are composed when they are read; a quote stands as it is or composed.
    as_is = F.expr("locate(quote, text)")
    found = F.when(as_is > 0, F.col("quote")).otherwise(F.col("nfc"))
    out = out.withColumn("found", found)
    at = F.expr("locate(found, text)")
    error = F.when(F.col("again"), "duplicate_evidence").when(F.col("text").isNull(), "chunk_not_allowed").when((at == 0) | (F.col("quote") == ""), "quote_not_found")
    start = F.col("char_start") + at - 1
    return out.select("doc_id", "rule_id", "pos", "chunk_id", "quote", error.alias("error"), F.when(error.isNull(), locator(F.col("digest"), start, start + F.length("found"))).alias("locator"))


def acceptable(quote: Column) -> Column:
    """Short, one fragment, no markup."""
    return (F.length(quote) <= QUOTE_CHARS) & (F.size(F.split(F.trim(quote), r"\s+")) <= QUOTE_WORDS) & ~quote.rlike(r"```|</?[A-Za-z][^>]*>")


def prompts(planned: DataFrame, wire_ids: int = 8) -> DataFrame:
    """What a provider is sent: ``prompt`` (JSON of the rule, its elements and the chunks) and its ``prompt_hash``.

    From ``wire_ids`` elements on they go by number, which answers must use as well.
    """
    numbered = F.transform("elements", lambda e, i: F.when(F.size("elements") >= wire_ids, i.cast("string")).otherwise(e))
    body = F.to_json(F.struct("rule_id", numbered.alias("elements"), F.transform("chunks", lambda c: F.struct(c["chunk_id"].alias("id"), c["text"].alias("text"))).alias("chunks")))
    return planned.where("state = 'ready'").select("doc_id", "rule_id", "elements", body.alias("prompt")).withColumn("prompt_hash", F.sha2("prompt", 256))


ANSWER = "status string, confidence double, elements array<string>, evidence array<struct<chunk_id:string,quote:string>>, diagnostic string, attempts int, provider string, tokens_in long, tokens_out long"


def ask(prompted: DataFrame, providers: list[tuple[str, Callable[[str], dict]]], attempts: int = 2, tasks: int | None = None) -> DataFrame:
    """Answers of the first provider that gives one whose elements are those asked for (by name or by number).

    A provider is a name and a function from a prompt to a dictionary; it may raise. An unavailable provider passes on to the next, an
    invalid answer is asked for once more. What is left is a diagnostic, never an error. ``tasks`` bounds how many calls run at once.
    """
    import pandas as pd

    def one(prompt: str, elements: list[str]) -> dict:
        last, n, spent = {"diagnostic": "no_provider", "provider": None}, 0, {"tokens_in": 0, "tokens_out": 0}
        for name, call in providers:
            for _ in range(attempts):
                n += 1
                try:
                    got = call(prompt)
                except Exception:
                    last = {"diagnostic": "provider_unavailable", "provider": name}
                    break
                for k in spent:  # also what an invalid answer has cost
                    spent[k] += int(got.get(k) or 0)
                named = [elements[int(e)] if str(e).isdigit() and int(e) < len(elements) else e for e in got.get("elements") or []]
                if got.get("status") in ("pass", "warn", "info", "unverifiable", "not_applicable") and sorted(named) == sorted(elements):
                    return {"status": got["status"], "confidence": got.get("confidence"), "elements": named, "evidence": got.get("evidence") or [], "diagnostic": None, "attempts": n, "provider": name} | spent
                last = {"diagnostic": "invalid_answer", "provider": name}
        return {"status": None, "confidence": None, "elements": None, "evidence": None, "attempts": n} | last | spent

    def run(batches):
        for pdf in batches:
            rows = [one(p, list(e)) for p, e in zip(pdf["prompt"], pdf["elements"], strict=True)]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWER.replace("array<struct<chunk_id:string,quote:string>>", "x").split(", ")])
            yield pd.concat([pdf[["doc_id", "rule_id", "prompt_hash"]].reset_index(drop=True), out], axis=1)

    source = prompted.coalesce(tasks) if tasks else prompted
    key = prompted.select("doc_id", "rule_id", "prompt_hash").schema
    return source.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in key) + ", " + ANSWER)


def observed(answers: DataFrame, name: str = "advisory") -> tuple[DataFrame, Observation]:
    """``answers`` and what a pass over them will have told: questions, attempts, tokens each way and how many had no answer, without another job."""
    seen = Observation(name)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return answers.observe(seen, F.count(F.lit(1)).alias("questions"), total("attempts"), total("tokens_in"), total("tokens_out"), F.count_if(F.col("diagnostic").isNotNull()).alias("unanswered")), seen


def disabled(planned: DataFrame) -> DataFrame:
    """The provider that answers nothing."""
    return planned.where("state = 'ready'").select("doc_id", "rule_id", F.lit("provider_disabled").alias("diagnostic"))


def annotated(planned: DataFrame, answers: DataFrame) -> DataFrame:
    """The provider that answers from a table: ``status``, ``confidence`` and ``evidence`` (``chunk_id``, ``quote``) by document and rule."""
    return planned.where("state = 'ready'").join(answers, ["doc_id", "rule_id"], "left").select("doc_id", "rule_id", F.when(F.col("status").isNull(), "no_answer").alias("diagnostic"), "status", "confidence", "evidence")


def conclude(planned: DataFrame, answered: DataFrame, digests: DataFrame) -> DataFrame:
    """Findings of the advisory stage.

    No section: not applicable. No answer, a status that isn't allowed, a quote that fails its check or an unacceptable one: unverifiable.
    """
    if "evidence" in answered.columns:
        shown = planned.select("doc_id", "rule_id", F.explode("chunks").alias("c")).select("doc_id", "rule_id", "c.chunk_id", "c.text", "c.char_start").join(digests, "doc_id")
        quotes = answered.select("doc_id", "rule_id", F.posexplode("evidence").alias("pos", "e")).select("doc_id", "rule_id", "pos", "e.chunk_id", "e.quote")
        checked = verify(quotes, shown).groupBy("doc_id", "rule_id").agg(F.bool_and(F.col("error").isNull() & acceptable(F.col("quote"))).alias("sound"), F.array_sort(F.collect_list(F.struct("locator", F.col("quote").alias("description")))).alias("evidence"))
        out = planned.join(answered.drop("evidence"), ["doc_id", "rule_id"], "left").join(checked, ["doc_id", "rule_id"], "left")
    else:
        # Without quotes no text is looked at.
        told = {"status": "string", "confidence": "double", "sound": "boolean", "evidence": "array<struct<locator:string,description:string>>"}
        out = planned.join(answered, ["doc_id", "rule_id"], "left").withColumns({c: F.lit(None).cast(t) for c, t in told.items()})
    allowed = F.col("status").isin("pass", "warn", "info", "unverifiable", "not_applicable")
    good = allowed & (F.col("sound") | ~F.col("status").isin("pass", "warn")) & (F.col("confidence").between(0, 1) | F.col("confidence").isNull())
    status = F.when(F.col("state") == "section_missing", "not_applicable").when(F.coalesce(good, F.lit(False)), F.col("status")).otherwise("unverifiable")
    message = F.when(F.col("state") == "section_missing", "section_missing").when(F.col("diagnostic").isNotNull(), F.col("diagnostic")).when(F.coalesce(good, F.lit(False)), "assessed").otherwise("invalid_answer")
    none = F.array().cast("array<struct<locator:string,description:string>>")
    return out.select("doc_id", F.lit("semantic").alias("stage"), "rule_id", F.lit("llm").alias("layer"), F.when(status == "warn", "warn").otherwise("info").alias("severity"), status.alias("status"), message.alias("message"), F.when(F.coalesce("sound", F.lit(False)), F.coalesce("evidence", none)).otherwise(none).alias("evidence"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("page"))
