"""Evaluation-dataset distillation: run predicates, trace flags, field extraction, merges, formats.

Input: run table rows with ``trace_id, project, run_date, run_id, ord`` and the run document
``doc`` (VARIANT). Every per-run rule is a column expression; every per-trace step is one
``groupBy(trace_id, project, run_date)`` with partial-aggregable functions (``bool_or``, ``max_by``,
``min_by``), so no trace is ever collected into one task or the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import variant as V
from runlens.operators import merge as M
from runlens.session import staged

TRACE_KEYS = ["trace_id", "project", "run_date"]
EVAL_TYPES = ("token_name", "website", "availability")
# Fixed text in front of a verdict.
VERDICT_MARK = "Human verdict:"

INPUT_FIELDS = ["name", "description", "symbol", "website_url", "network", "contract_address", "social_profiles"]
BOOL_OUTPUTS = ["is_meme", "is_explicit", "has_conflict", "has_trademark_conflict"]
REFERENCE_FIELDS = ["feedback_score", "feedback_value", "feedback_comment", "human_verdict"]

# Fixed note texts of the availability cascade (must equal the reference's).
NOTE_SCRAPED = "Website accessible - content successfully scraped"
NOTE_ANALYSIS_OK = "Website accessible - analysis completed successfully"
NOTE_ANALYSIS_NOT = "Website not accessible - analysis completed"
NOTE_PASS = "Website accessible - evaluation completed with PASS decision"
NOTE_FAIL = "Website accessibility issues - evaluation resulted in FAIL decision"
NOTE_APPEARS = "Website appears to be accessible"
NOTE_ERRORS = "Website may be unavailable - errors detected during access"
NOTE_UNCLEAR = "Website availability status unclear"


def _d(doc) -> Column:
    return F.col(doc) if isinstance(doc, str) else doc


def _str(v: Column) -> Column:
    """Python ``str(x)`` approximation for JSON values: strings as-is, others as JSON text, null as NULL."""
    return V.text_at(v)


# ------------------------------------------------------------------------------- staging
# Sub-documents used by many rules are materialised once as named columns, in stages. Building
# them inline would duplicate every nested expression at each use (the expression tree grows
# exponentially); as separate projections Catalyst keeps them shared (CollapseProject does not
# inline non-trivial expressions referenced more than once). An object is opened once, into a struct of
# the members that the rules read: a member taken alone is searched for, and built anew, at each use.
STAGED = ["_doc", "_d", "_out", "_o", "_i", "_im", "_i_filled", "_url_in", "_ia", "_fb", "_fv0", "_v", "_n", "_w", "_run_out"]
_CHECKS = ["meme_check", "explicit_check", "trademark_check"]
_NOTES = ["error_message", "availability_notes", "notes"]
_INPUT_KEYS = ["name", "description", "crypto_symbol", "symbol", "website_url", "network", "contract_address",
               "social_profiles"]
_OUTPUT_KEYS = ["final_decision", "confidence", "human_verdict", "name_analysis", "website_analysis", *_CHECKS, *_NOTES,
                "is_meme", "is_explicit", "has_conflict", "has_trademark_conflict", "is_available", "is_malicious",
                "project_info", "social_links", "page_links"]
_INPUTS = "struct<input_data:struct<{}>,{}>".format(*[
    ",".join(f"{k}:variant" for k in keys) for keys in (["request_id", *_INPUT_KEYS], _INPUT_KEYS)])


def stage(runs: DataFrame, doc: str = "doc") -> DataFrame:
    """Add the staged sub-document columns (prefixed ``_``) used by the rules below."""
    s1 = runs.withColumns({
        "_doc": F.col(doc),
        "_d": V.fields(doc, ["outputs", "feedback_stats", "feedback", "run", "reference", "start_time"]),
        # inputs are opened from the document down to the members that are read; no object in between is built anew
        "_i": F.try_variant_get(doc, "$.inputs", _INPUTS),
        "_im": F.try_variant_get(doc, "$.inputs", "map<string,struct<website_url:variant>>"),
    })
    s2 = s1.withColumns({
        "_out": F.when(V.filled_object("_d.outputs"), F.col("_d.outputs")),
        "_o": V.fields("_d.outputs", _OUTPUT_KEYS),
        "_i_filled": F.coalesce(F.size("_im") > 0, F.lit(False)),
        "_url_in": F.coalesce(F.exists(F.map_values("_im"), lambda v: v.getField("website_url").isNotNull()), F.lit(False)),
        "_ia": F.col("_i.input_data"),
        "_fb": F.coalesce(F.try_variant_get("_d.feedback", "$", "array<variant>"), F.array().cast("array<variant>")),
        "_fv0": V.sub("_d.feedback_stats", "$.final_verdict"),
        "_run_out": V.sub("_d.run", "$.outputs"),
    })
    return s2.withColumns({
        "_v": V.fields("_fv0", ["comments", "verdict"]),
        "_n": V.fields("_o.name_analysis", _CHECKS),
        "_w": V.fields("_o.website_analysis", [*_CHECKS, *_NOTES, "is_available", "malicious_check"]),
    })


def unstage(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in STAGED if c in df.columns])

# ------------------------------------------------------------------------------- P5 .. P11
# The rules below read the staged columns of ``stage()``.
def has_ai_output() -> Column:
    """P5: non-empty ``outputs`` object, or a non-empty ``run.outputs`` object."""
    return F.col("_out").isNotNull() | V.filled_object("_run_out")


def has_human_feedback() -> Column:
    """feedback_stats.final_verdict key, non-empty feedback, outputs.human_verdict key or
    reference.human_feedback key."""
    return (F.col("_fv0").isNotNull() | V.truthy("_d.feedback") | F.col("_o.human_verdict").isNotNull()
            | V.present("_d.reference", "$.human_feedback"))


def _comments() -> Column:
    arr = F.try_variant_get("_v.comments", "$", "array<variant>")
    return F.transform(F.coalesce(arr, F.array().cast("array<variant>")), lambda c: _str(c))


def _feedback_verdicts() -> Column:
    """Verdict values of ``feedback[]`` items that carry a truthy final_verdict with a verdict key."""
    ok = F.filter("_fb", lambda fb: V.is_object(fb) & V.is_object(V.sub(fb, "$.final_verdict"))
                  & V.truthy(V.sub(fb, "$.final_verdict")) & V.present(V.sub(fb, "$.final_verdict"), "$.verdict"))
    return F.transform(ok, lambda fb: V.sub(fb, "$.final_verdict.verdict"))


def has_final_verdict_feedback() -> Column:
    """A final_verdict comment containing 'Human verdict:', a final_verdict.verdict key, or a
    feedback[] item with final_verdict.verdict."""
    by_comment = F.exists(_comments(), lambda c: F.instr(c, VERDICT_MARK) > 0)
    return F.coalesce(by_comment | F.col("_v.verdict").isNotNull(), F.lit(False)) | (F.size(_feedback_verdicts()) > 0)


def feedback_verdict() -> Column:
    """Verdict precedence: comment tail exactly PASS/FAIL -> final_verdict.verdict -> feedback[]."""
    tails = F.transform(F.filter(_comments(), lambda c: F.instr(c, VERDICT_MARK) > 0),
                        lambda c: F.regexp_replace(F.try_element_at(F.split(c, VERDICT_MARK, -1), F.lit(-1)), r"(?U)^\s+|\s+$", ""))
    from_comment = F.try_element_at(F.filter(tails, lambda t: t.isin("PASS", "FAIL")), F.lit(1))
    from_key = _str(F.col("_v.verdict"))
    from_fb = F.try_element_at(_feedback_verdicts(), F.lit(1))
    return F.coalesce(from_comment, from_key, F.when(from_fb.isNotNull(), _str(from_fb)))


def decision_and_confidence() -> tuple[Column, Column]:
    """Outputs.final_decision and float(outputs.confidence) (None when not convertible)."""
    return _str(F.col("_o.final_decision")), V.to_double("_o.confidence", "$")


def has_website_url() -> Column:
    """Inputs has website_url, or one of its object values has it."""
    return F.col("_i.website_url").isNotNull() | F.col("_url_in")


def meets_criteria(eval_type: str | None = None, min_confidence: float = 0.7) -> Column:
    """P10: availability -> P11; else P7 and verdict == decision (both non-empty) and confidence
    >= 0.7 (NaN never qualifies)."""
    if eval_type == "availability":
        return has_website_url()
    verdict = feedback_verdict()
    dec, conf = decision_and_confidence()
    match = (F.length(verdict) > 0) & (F.length(dec) > 0) & (verdict == dec)
    enough = conf.isNotNull() & ~F.isnan(conf) & (conf >= min_confidence)
    return F.coalesce(has_final_verdict_feedback() & match & enough, F.lit(False))


def run_flags(runs: DataFrame, eval_type: str | None = None, doc: str = "doc") -> DataFrame:
    """Per run: has_ai_output, has_human_feedback, meets_criteria."""
    st = stage(runs, doc)
    return unstage(st.withColumns({"has_ai_output": has_ai_output(), "has_human_feedback": has_human_feedback(),
                                   "meets_criteria": meets_criteria(eval_type)}))


# ------------------------------------------------------------------------------- A10
def trace_flags(runs: DataFrame, eval_type: str | None = None, doc: str = "doc") -> DataFrame:
    """A10: per trace (trace_id, project, run_date): has_ai_output, has_human_feedback and
    meets_criteria, each true if any run has it."""
    f = run_flags(runs.where(F.col("trace_id").isNotNull()), eval_type, doc)
    return f.groupBy(*TRACE_KEYS).agg(
        F.bool_or("has_ai_output").alias("has_ai_output"),
        F.bool_or("has_human_feedback").alias("has_human_feedback"),
        F.bool_or("meets_criteria").alias("meets_criteria"),
        F.count(F.lit(1)).alias("run_count"))


def qualified_traces(runs: DataFrame, eval_type: str | None = None, doc: str = "doc") -> DataFrame:
    """S3+A10: traces that meet the criteria of ``eval_type``."""
    return trace_flags(runs, eval_type, doc).where("meets_criteria").drop("meets_criteria")


# ------------------------------------------------------------------------------- A13 / W1
def file_trace_summary(runs: DataFrame, doc: str = "doc") -> DataFrame:
    """A13 (file mode): per trace_id: earliest start_time (missing sorts first), first non-empty
    request_id (inputs.input_data.request_id, by run order), any-run flags, run count."""
    st = stage(runs.where(F.col("trace_id").isNotNull()), doc)
    return _summary_of_traces(st.withColumns(_summary_columns()))


def _summary_columns() -> dict:
    return {"_rid": _str(F.col("_ia.request_id")), "_st": F.coalesce(V.as_string("_d.start_time"), F.lit("")),
            "_ai": has_ai_output(), "_hf": has_human_feedback(), "_mc": meets_criteria()}


def _summary_of_traces(st: DataFrame) -> DataFrame:
    return st.groupBy("trace_id").agg(
        F.min("_st").alias("start_time"),
        F.min_by("_rid", F.when(F.length("_rid") > 0, F.col("ord"))).alias("request_id"),
        F.min("ord").alias("ord"),
        F.bool_or("_ai").alias("has_ai_output"),
        F.bool_or("_hf").alias("has_human_feedback"),
        F.bool_or("_mc").alias("meets_criteria"),
        F.count(F.lit(1)).alias("runs_processed"))


def dedup_by_request(traces: DataFrame) -> DataFrame:
    """Of the traces that meet the criteria (all, where they are not marked by ``meets_criteria``), one per
    request_id (trace_id when there is none): earliest start_time, ties -> first.

    Written as an aggregation (min over a struct) instead of ``row_number`` so that a request id
    holding a third of all traces is reduced map-side rather than sorted in one task."""
    key = F.coalesce(F.when(F.length("request_id") > 0, F.col("request_id")), F.col("trace_id"))
    cols = list(traces.columns)
    rest = [c for c in cols if c not in ("start_time", "ord")]
    qualified = traces.where("meets_criteria") if "meets_criteria" in traces.columns else traces
    best = qualified.groupBy(key.alias("dedup_key")).agg(
        F.min(F.struct(F.col("start_time"), F.col("ord"), *[F.col(c) for c in rest])).alias("_b"))
    return best.select("dedup_key", *[F.col("_b." + c).alias(c) for c in cols])


# ------------------------------------------------------------------------------- P15 .. P18
def extract_inputs(staged: bool = True) -> dict:
    """{field: (present, value)} from inputs.input_data, falling back to direct inputs when
    input_data yields nothing. ``symbol`` is crypto_symbol, else symbol."""
    def members(src):
        res = {f: (F.col(f"{src}.{f}").isNotNull(), F.col(f"{src}.{f}")) for f in _INPUT_KEYS}
        symbol = F.coalesce(res.pop("crypto_symbol")[1], res["symbol"][1])
        return res | {"symbol": (symbol.isNotNull(), symbol)}

    a = members("_ia")
    any_a = None
    for p, _ in a.values():
        any_a = p if any_a is None else (any_a | p)
    b = members("_i")
    use_b = F.col("_use_b") if staged else (~any_a & F.col("_i_filled"))
    if not staged:
        return {"_use_b": use_b}
    out = {}
    for f in INPUT_FIELDS:
        pa, va = a[f]
        pb, vb = b[f]
        out[f] = (pa | (use_b & pb), F.when(pa, va).when(use_b & pb, vb))
    return out


def extract_outputs(staged: bool = True) -> dict:
    """P16+P17: {field: (present, value)} for is_meme, is_explicit, has_conflict,
    has_trademark_conflict (always present), is_available, is_malicious (website block or cascade),
    notes (always present, string)."""
    def truthy(name):
        return V.truthy("_o." + name)

    def nonnull(v):
        return v.isNotNull() & ~F.is_variant_null(v)

    def first_given(key, *places):  # a key that is there counts, whatever its value
        return F.coalesce(*[F.col(f"{place}.{key}") for place in places])

    out = {}
    for check, field in (("meme_check", "is_meme"), ("explicit_check", "is_explicit")):
        v = first_given(check, "_n", "_w", "_o")
        val = (F.when(V.is_object(v), V.truthy_at(v, "$." + field))
               .when(v.isNotNull() & ~F.coalesce(F.is_variant_null(v), F.lit(False)), V.truthy(v))
               .otherwise(truthy(field)))
        out[field] = (F.lit(True), val)
    tc = first_given("trademark_check", "_n", "_w", "_o")
    tc_obj = V.is_object(tc)
    hc = F.when(tc_obj, V.truthy_at(tc, "$.has_conflict")).otherwise(truthy("has_conflict"))
    htc = F.when(tc_obj, V.truthy_at(tc, "$.has_conflict")).otherwise(
        F.when(F.col("_o.has_trademark_conflict").isNotNull(), truthy("has_trademark_conflict"))
        .otherwise(truthy("has_conflict")))
    out["has_conflict"] = (F.lit(True), hc)
    out["has_trademark_conflict"] = (F.lit(True), htc)

    if not staged:
        wa, wa_avail, to_avail = F.col("_o.website_analysis"), F.col("_w.is_available"), F.col("_o.is_available")
        block = V.filled_object(wa) | nonnull(to_avail)
        block_avail = (F.when(nonnull(wa_avail), V.truthy(wa_avail)).when(nonnull(to_avail), V.truthy(to_avail))
                       .otherwise(F.lit(True)))
        mal = F.col("_w.malicious_check")
        block_mal = F.when(V.is_object(mal), V.truthy_at(mal, "$.is_dangerous")).otherwise(truthy("is_malicious"))
        # P17 notes: explicit note (website_analysis, then outputs) else an inferred note
        n1, n2 = (F.coalesce(*[F.col(f"{place}.{key}") for key in _NOTES]) for place in ("_w", "_o"))
        explicit = F.when(V.truthy(n1), n1).when(V.truthy(n2), n2)
        has_pi = truthy("project_info") | truthy("social_links") | truthy("page_links")
        has_an = truthy("website_analysis") | truthy("name_analysis")
        return {"_block": block, "_block_avail": block_avail, "_block_mal": block_mal, "_explicit": explicit,
                "_has_pi": has_pi, "_has_an": has_an, "_dec": V.as_string("_o.final_decision")}
    block, block_avail, block_mal = F.col("_block"), F.col("_block_avail"), F.col("_block_mal")
    explicit, has_pi, has_an = F.col("_explicit"), F.col("_has_pi"), F.col("_has_an")
    dec, words = F.col("_dec"), F.col("_words")
    cur_avail = F.when(block, block_avail).otherwise(F.lit(False))
    gen_note = (F.when(has_pi, F.lit(NOTE_SCRAPED))
                .when(has_an & ~block, F.lit(NOTE_ANALYSIS_OK))
                .when(has_an & cur_avail, F.lit(NOTE_ANALYSIS_OK))
                .when(has_an, F.lit(NOTE_ANALYSIS_NOT))
                .when(dec == "PASS", F.lit(NOTE_PASS))
                .when(dec == "FAIL", F.lit(NOTE_FAIL))
                .when(cur_avail, F.lit(NOTE_APPEARS))
                .when(words, F.lit(NOTE_ERRORS))
                .otherwise(F.lit(NOTE_UNCLEAR)))
    gen_avail_set = (F.when(has_pi, F.lit(True)).when(has_an, ~block)
                     .when(dec == "PASS", F.lit(True)).when(dec == "FAIL", F.lit(True))
                     .when(cur_avail, F.lit(False)).when(words, F.lit(True)).otherwise(F.lit(False)))
    gen_avail = (F.when(has_pi, F.lit(True)).when(has_an, F.lit(True))
                 .when(dec == "PASS", F.lit(True)).otherwise(F.lit(False)))
    use_gen = explicit.isNull()
    avail_present = block | (use_gen & gen_avail_set)
    avail = F.when(use_gen & gen_avail_set, gen_avail).when(block, block_avail)
    out["is_available"] = (avail_present, avail)
    out["is_malicious"] = (block, F.when(block, block_mal))
    out["notes"] = (F.lit(True), F.when(use_gen, gen_note).otherwise(_str(explicit)))
    return out


def error_words() -> Column:
    """Words of failure anywhere in the outputs; they are looked for only where no earlier note applies."""
    decided = (F.col("_explicit").isNotNull() | F.col("_has_pi") | F.col("_has_an")
               | F.coalesce(F.col("_dec").isin("PASS", "FAIL"), F.lit(False)) | (F.col("_block") & F.col("_block_avail")))
    return F.coalesce(F.when(~decided, F.lower(F.to_json("_out")).rlike("error|failed|timeout")), F.lit(False))


def last_feedback() -> Column:
    """Members of the last feedback[] object that P18 reads; NULL where there is no object."""
    objs = F.filter("_fb", lambda x: V.is_object(x))
    return F.when(F.size("_fb") > 0, V.fields(F.try_element_at(objs, F.lit(-1)), ["score", "value", "comment"]))


def extract_reference() -> dict:
    """Last feedback[] object's score/value/comment; outputs.human_verdict."""
    has = F.col("_last").isNotNull()
    return {
        "feedback_score": (has, F.col("_last.score")),
        "feedback_value": (has, F.col("_last.value")),
        "feedback_comment": (has, F.col("_last.comment")),
        "human_verdict": (F.col("_o.human_verdict").isNotNull(), F.col("_o.human_verdict")),
    }


def run_fields(runs: DataFrame, doc: str = "doc", eval_type: str | None = None, names: list[str] | None = None,
               more: dict | None = None) -> DataFrame:
    """Per run: presence flag ``<f>_p`` and value ``<f>`` (VARIANT or typed) of every extracted field (or those of
    ``names``), plus ``_meets`` (P10 for ``eval_type``) and the columns of ``more``, written over staged ones."""
    st = stage(runs, doc)
    st = st.withColumns({**extract_inputs(staged=False), **extract_outputs(staged=False), "_last": last_feedback()})
    st = st.withColumn("_words", error_words())
    cols = {}
    for group in (extract_inputs(), extract_outputs(), extract_reference()):
        for f, (p, v) in group.items():
            if names is None or f in names:
                cols[f + "_p"] = p
                cols[f] = v
    cols |= more or {}
    cols["_meets"] = meets_criteria(eval_type)
    keep = [c for c in TRACE_KEYS + ["run_id", "ord"] if c in runs.columns]
    return st.select(*keep, *[v.alias(k) for k, v in cols.items()])


# ------------------------------------------------------------------------------- A11 / A12
ALL_FIELDS = INPUT_FIELDS + BOOL_OUTPUTS + ["is_available", "is_malicious", "notes"] + REFERENCE_FIELDS
PROTECTED_AVAILABILITY = ("is_available", "notes")


def merge_last_wins(fields: DataFrame) -> DataFrame:
    """Per trace, each field takes the value of the last run (by ord) where it is present.

    ``max_by(v, ord) FILTER (present)`` is partial-aggregable: a huge trace is merged map-side."""
    aggs = []
    for f in _given(ALL_FIELDS, fields):
        aggs.append(F.max_by(F.col(f), F.when(F.col(f + "_p"), F.col("ord"))).alias(f))
        aggs.append(F.bool_or(F.col(f + "_p")).alias(f + "_p"))
    return fields.groupBy(*TRACE_KEYS).agg(*aggs, *_extra(fields))


def _given(names: list[str], fields: DataFrame) -> list[str]:
    return [f for f in names if f in fields.columns]


def _extra(fields: DataFrame) -> list:
    out = [F.count(F.lit(1)).alias("runs_count")]
    if "_meets" in fields.columns:
        out.append(F.bool_or("_meets").alias("_meets"))
    return out


def merge_root_priority(fields: DataFrame, protected=PROTECTED_AVAILABILITY) -> DataFrame:
    """Root run (run_id == trace_id) first; protected fields keep the root's value, else the
    first child's; other fields take the last child's value, else the root's."""
    not_root = F.col("run_id") != F.col("trace_id")
    aggs = []
    for f in _given(ALL_FIELDS, fields):
        order = F.when(F.col(f + "_p"), F.struct(not_root, F.col("ord")))
        fn = F.min_by if f in protected else F.max_by
        aggs.append(fn(F.col(f), order).alias(f))
        aggs.append(F.bool_or(F.col(f + "_p")).alias(f + "_p"))
    return fields.groupBy(*TRACE_KEYS).agg(*aggs, *_extra(fields))


VARIANT_FIELDS = INPUT_FIELDS + REFERENCE_FIELDS


def merge_objects(fields: DataFrame, merged: DataFrame, root_first: bool = False) -> DataFrame:
    """``merged``, with fields that several runs of a trace give as objects merged key by key, at any depth.

    Only such fields, of traces that qualify, are folded (``merge.deep_merge``), in the order of the merge: by ``ord``, with
    ``root_first`` the root before all others. A value that is no object replaces what came before it.
    """
    order = F.struct(F.col("run_id") != F.col("trace_id"), F.col("ord")) if root_first else F.col("ord")
    names = _given(VARIANT_FIELDS, fields)
    meets = F.bool_or("_meets") if "_meets" in fields.columns else F.lit(True)
    counts = fields.groupBy(*TRACE_KEYS).agg(meets.alias("_meets"), *[
        F.count_if(F.col(f + "_p") & V.is_object(f)).alias(f) for f in names]).where("_meets")
    several = staged(counts.select(*TRACE_KEYS, F.explode(F.array(*[
        F.when(F.col(f) > 1, F.lit(f)) for f in names])).alias("field")).where("field IS NOT NULL"), "objects")
    if several.isEmpty():
        return merged
    keys = [*TRACE_KEYS, "field"]
    given = F.array(*[F.struct(F.lit(f).alias("field"), F.when(F.col(f + "_p"), F.col(f)).alias("value")) for f in names])
    long = (fields.select(*TRACE_KEYS, order.alias("ord"), F.explode(given).alias("x"))
            .select(*TRACE_KEYS, "ord", "x.*").where("value IS NOT NULL"))
    docs = staged(long.join(several, keys, "left_semi").select(
        *keys, "ord", F.to_variant_object(F.struct(F.col("value").alias("v"))).alias("doc")), "to-merge")
    folded = M.deep_merge(docs, keys).select(*keys, F.to_json(V.sub("doc", "$.v")).alias("text"))
    wide = folded.groupBy(*TRACE_KEYS).agg(*[F.max(F.when(F.col("field") == f, F.col("text"))).alias("_" + f)
                                             for f in names])
    both = merged.join(wide, TRACE_KEYS, "left")
    return both.withColumns({f: F.coalesce(F.parse_json("_" + f), F.col(f)) for f in names}).select(*merged.columns)


# ------------------------------------------------------------------------------- P19 .. P22
FORMAT_COLUMNS = {
    "token_name": (["name", "symbol", "description"], ["is_meme", "is_explicit", "has_conflict"]),
    "website": (["name", "symbol", "network", "description", "website_url", "social_profiles", "contract_address"],
                ["is_meme", "is_explicit", "is_available", "is_malicious", "has_trademark_conflict"]),
    "availability": (["website_url"], ["is_available", "notes"]),
}
_OUTPUT_DEFAULTS = {"is_meme": False, "is_explicit": False, "has_conflict": False, "is_malicious": False,
                    "has_trademark_conflict": False}


def apply_format(merged: DataFrame, eval_type: str) -> DataFrame:
    """Project the merged fields to the example schema of ``eval_type`` (flat columns).

    Input fields are rendered as strings (JSON text for non-strings; social_profiles default '[]');
    outputs are booleans with the per-type defaults (website: is_available True; availability:
    is_available False, notes '')."""
    if eval_type not in FORMAT_COLUMNS:
        return merged
    ins, outs = FORMAT_COLUMNS[eval_type]
    cols = [F.col(k) for k in TRACE_KEYS]
    for f in ins:
        if f == "social_profiles":
            cols.append(F.when(F.col(f + "_p"), F.to_json(F.col(f))).otherwise(F.lit("[]")).alias(f))
        else:
            cols.append(F.when(F.col(f + "_p"), _str(F.col(f))).otherwise(F.lit("")).alias(f))
    for f in outs:
        if f == "notes":
            cols.append(F.when(F.col(f + "_p"), F.col(f)).otherwise(F.lit("")).alias(f))
        elif f == "is_available":
            dflt = eval_type == "website"
            cols.append(F.when(F.col(f + "_p"), F.col(f)).otherwise(F.lit(dflt)).alias(f))
        else:
            cols.append(F.when(F.col(f + "_p"), F.col(f)).otherwise(F.lit(_OUTPUT_DEFAULTS[f])).alias(f))
    ref = F.struct(*[F.when(F.col(f + "_p"), F.col(f)).alias(f) for f in REFERENCE_FIELDS])
    return merged.select(*cols, ref.alias("reference"), "runs_count", inputs_json(ins).alias("inputs_json"))


def inputs_json(ins: list[str]) -> Column:
    """The inputs of an example as JSON text, every value as the runs gave it; defaults only for absent fields."""
    fields = []
    for f in ins:
        default = "[]" if f == "social_profiles" else '""'
        value = F.coalesce(F.when(F.col(f + "_p"), F.to_json(F.col(f))), F.lit(default))
        fields.append(F.concat(F.lit(f'"{f}":'), value))
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def format_fields(eval_type: str) -> list[str]:
    """The fields that an example of ``eval_type`` is made of."""
    ins, outs = FORMAT_COLUMNS[eval_type]
    return ins + outs + REFERENCE_FIELDS


def build_dataset(runs: DataFrame, eval_type: str, doc: str = "doc") -> DataFrame:
    """Extraction, qualification (A10), merge (A11 / A12) and format of the runs of the qualifying traces.

    Every document is built or parsed once: the fields of the format are staged with the outcome of P10, and the
    merges read them instead of documents. No per-trace re-query (J3)."""
    if eval_type not in EVAL_TYPES:
        raise ValueError(f"eval_type must be one of {EVAL_TYPES}")
    known = runs.where(F.col("trace_id").isNotNull())
    fields = staged(run_fields(known, doc, eval_type, format_fields(eval_type)), "fields", many_rules=True)
    by_root = eval_type == "availability"
    merged = (merge_root_priority(fields) if by_root else merge_last_wins(fields)).where("_meets")
    return apply_format(merge_objects(fields, merged, by_root), eval_type)


def build_dataset_file_mode(runs: DataFrame, eval_type: str, doc: str = "doc") -> DataFrame:
    """The dataset of landed files. ``ord`` is the order of the files' paths.

    Of the traces that qualify (the strict rule, whatever the type) one stands for each request. Its files are folded
    in order: a field takes the value of the last file that has it, whole (objects replace objects), and
    ``runs_count`` says how many files there were. Every document is read once, as in ``build_dataset``.
    """
    if eval_type not in EVAL_TYPES:
        raise ValueError(f"eval_type must be one of {EVAL_TYPES}")
    known = runs.where(F.col("trace_id").isNotNull())
    fields = staged(run_fields(known, doc, None, format_fields(eval_type), _summary_columns()), "fields",
                    many_rules=True)
    met = fields.where("_meets").select(*TRACE_KEYS).distinct()
    same = [fields[k].eqNullSafe(met[k]) for k in TRACE_KEYS]
    kept = staged(fields.join(met, same, "left_semi"), "qualifying")
    chosen = dedup_by_request(_summary_of_traces(kept)).select("trace_id")
    return apply_format(merge_last_wins(kept.join(chosen, "trace_id", "left_semi")), eval_type)


# ------------------------------------------------------------------------------- J1
def feedback_in_documents(runs: DataFrame, feedback: DataFrame, doc: str = "doc", key: str = "run_id") -> DataFrame:
    """J1 at ingest: the documents of runs with feedback get ``feedback_records``, the list of their feedback rows as
    objects (all columns, the key and nulls included), in the order of their JSON texts; an older list is replaced.

    Runs without feedback, and documents that are no objects, stay as they are; feedback without a key, or of no
    run, goes. Feedback is grouped before the join, so runs are never multiplied; the list of a run is as long
    as that run's feedback, since the document holds it.
    """
    record = F.to_json(F.struct(*feedback.columns), {"ignoreNullFields": "false"})
    lists = feedback.where(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(record)).alias("_records"))
    fields = F.map_filter(F.try_variant_get(doc, "$", "map<string,variant>"), lambda name, _: name != "feedback_records")
    records = F.parse_json(F.concat(F.lit("["), F.array_join("_records", ","), F.lit("]")))
    with_list = F.to_variant_object(F.map_concat(fields, F.create_map(F.lit("feedback_records"), records)))
    changed = F.col("_records").isNotNull() & V.is_object(doc)
    return (runs.join(lists, key, "left").withColumn(doc, F.when(changed, with_list).otherwise(F.col(doc)))
            .select(*runs.columns))


def attach_feedback(runs: DataFrame, feedback: DataFrame, key: str = "run_id") -> DataFrame:
    """Every run with the list of its feedback records (runs without feedback keep an empty list).

    Feedback is grouped per run *before* the join, so the join is 1:1 on run_id and its output never
    multiplies runs; the per-run list is bounded by the feedback of one run."""
    fb_cols = [c for c in feedback.columns if c != key]
    per_run = feedback.groupBy(key).agg(F.collect_list(F.struct(*fb_cols)).alias("feedback_records"))
    return (runs.join(per_run, key, "left")
            .withColumn("feedback_records",
                        F.coalesce("feedback_records", F.array().cast(per_run.schema["feedback_records"].dataType))))
