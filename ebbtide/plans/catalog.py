"""The named queries: every operator over the given tables.

Each takes a session and a folder of Parquet tables. Array results are flattened to
rows or joined to text, so that engines without nested types can be compared with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ebbtide.functions import flags
from ebbtide.functions.plans import once
from ebbtide.operators import (
    actions,
    attribution,
    brief,
    clean,
    derive,
    encode,
    evaluate,
    explain,
    indicators,
    leafwise,
    panel,
    score,
    split,
    validate,
)
from ebbtide.operators.attribution import Node
from ebbtide.operators.boosted import fit, load, losses_by_round
from ebbtide.operators.linear import LinearModel
from ebbtide.plans import scoring, training
from ebbtide.schema import (
    FEATURE_COLUMNS, FIELDS, MONEY, YES_NO_FIELDS, DataConfig, ModelConfig, check_contract,
)
from ebbtide.session import fresh_path
from ebbtide.sources import files, generator, ledger, profiles, telco
from ebbtide.streaming import requests, rollups
from ebbtide.streaming import scoring as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MODEL = LinearModel()
# Queries that only need *a* boosted model keep it small; 300 trees is the default.
SMALL = ModelConfig(trees=12, step=0.2)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    return telco.customers(spark, folder)


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.score_linear(_customers(spark, folder), MODEL)


def _explained(spark: SparkSession, folder: str, style: str = "faithful") -> DataFrame:
    return scoring.explain_linear(_customers(spark, folder), MODEL, style=style)


def _generated(spark: SparkSession, folder: str) -> DataFrame:
    """A random customer per order, with a label that can be learned."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    keys = orders.select(F.col("o_orderkey").alias("key"))
    return generator.with_planted_churn(generator.customers_for(keys))


def _generated_features(spark: SparkSession, folder: str) -> DataFrame:
    """The generated customers encoded. Several columns ask for one draw, which is made once."""
    made = _generated(spark, folder)
    drawn = once(made, {c: F.col(c) for c in made.columns if c != "key"})
    return encode.features(drawn, ("key", "Churn"))


def _text(items: Column, separator: str = "|") -> Column:
    return F.array_join(items, separator)


# --- encoding ---------------------------------------------------------------------

@query
def telco_view(spark: SparkSession, folder: str) -> DataFrame:
    return _customers(spark, folder)


@query
def rename_sanitise(spark: SparkSession, folder: str) -> DataFrame:
    return encode.sanitise_columns(encode.rename_fields(_customers(spark, folder)))


@query
def encode_51(spark: SparkSession, folder: str) -> DataFrame:
    return encode.features(_customers(spark, folder))


@query
def encode_missing(spark: SparkSession, folder: str) -> DataFrame:
    return encode.features(telco.with_gaps(_customers(spark, folder)))


@query
def encode_missing_absent(spark: SparkSession, folder: str) -> DataFrame:
    gaps = telco.with_gaps(_customers(spark, folder))
    return encode.features(gaps, null_means=encode.NULL_IS_ABSENT)


@query
def encode_text(spark: SparkSession, folder: str) -> DataFrame:
    """Text in number fields: numbers are read, anything else counts as 0."""
    return encode.features(telco.as_form(_customers(spark, folder)))


@query
def align_report(spark: SparkSession, folder: str) -> DataFrame:
    """A table that lacks fields and has others, brought to the model's columns."""
    partial = _customers(spark, folder).drop("CLTV", "SeniorCitizen", "Offer", "tenure")
    frame, report = encode.align(encode.encode(partial), FEATURE_COLUMNS)
    return frame.withColumns({
        "missing": F.lit("|".join(report.missing)), "extras": F.lit("|".join(report.extras)),
    })


# --- validation -------------------------------------------------------------------

def _checked(spark: SparkSession, folder: str) -> DataFrame:
    return validate.check_records(telco.damaged_records(_customers(spark, folder)))


@query
def validate_valid(spark: SparkSession, folder: str) -> DataFrame:
    return validate.valid_records(_checked(spark, folder), "key")


@query
def validate_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    return validate.quarantine(_checked(spark, folder), "key").select(
        "key", _text(F.col("errors")).alias("errors")
    )


@query
def validate_form(spark: SparkSession, folder: str) -> DataFrame:
    form = flags.blanks_to_null(telco.as_form(_customers(spark, folder)))
    return validate.check_ranges(form).select("key", _text(F.col("errors")).alias("errors"))


@query
def form_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Forms that pass the rules, as typed records."""
    form = flags.blanks_to_null(telco.as_form(_customers(spark, folder)))
    good = validate.check_ranges(form).filter(F.size("errors") == 0).drop("errors")
    return validate.as_numbers(good)


@query
def binary_normalise(spark: SparkSession, folder: str) -> DataFrame:
    spelled = telco.with_spelled_flags(_customers(spark, folder))
    return flags.normalise_flags(spelled).select("key", *YES_NO_FIELDS, "Contract", "Age")


@query
def binary_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Flags as a table with gaps has them after inference: numbers with a fraction."""
    shifted = _customers(spark, folder).withColumns({
        n: (F.when(F.col("key") % 5 != 0, F.col(n)) + F.when(F.col("key") % 7 == 0, 0.5)
            .otherwise(0.0)).cast("double") for n in YES_NO_FIELDS})
    return flags.normalise_flags(shifted).select("key", *YES_NO_FIELDS)


@query
def yes_no_text(spark: SparkSession, folder: str) -> DataFrame:
    spelled = telco.with_spelled_flags(_customers(spark, folder))
    return spelled.select("key", *[flags.to_yes_no(F.col(n)).alias(n) for n in YES_NO_FIELDS])


@query
def missing_inputs(spark: SparkSession, folder: str) -> DataFrame:
    form = telco.as_form(_customers(spark, folder))
    return form.select("key", _text(flags.missing_inputs(form)).alias("missing"))


@query
def score_contract(spark: SparkSession, folder: str) -> DataFrame:
    return validate.score_violations(_explained(spark, folder))


# --- scores -----------------------------------------------------------------------

@query
def score_linear(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select(
        "key", "prediction", "churn_probability", "retention_risk"
    )


@query
def score_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Validated records scored the way single records are: null means absent."""
    gaps = telco.with_gaps(_customers(spark, folder))
    return scoring.score_linear(gaps, MODEL, null_means=encode.NULL_IS_ABSENT).select(
        "key", "prediction", "churn_probability", "retention_risk"
    )


@query
def score_file_output(spark: SparkSession, folder: str) -> DataFrame:
    """Input columns with score and call appended, through a Parquet file."""
    path = fresh_path(spark, "scores")
    scoring.append_scores(_customers(spark, folder), MODEL).write.parquet(path)
    return spark.read.parquet(path)


def _scored_file(spark: SparkSession, folder: str) -> tuple[str, str]:
    source, scores, rejected = (fresh_path(spark, n) for n in ("form", "scores", "rejected"))
    files.write_csv(telco.as_form(_customers(spark, folder)), source)
    scoring.score_file(spark, source, scores, rejected, MODEL)
    return scores, rejected


@query
def score_file_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """A CSV of forms, some of them wrong, through the file scoring job: the rejected."""
    _, rejected = _scored_file(spark, folder)
    return spark.read.parquet(rejected).select("key", _text(F.col("errors")).alias("errors"))


@query
def score_file_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The same job: the scored."""
    scores, _ = _scored_file(spark, folder)
    return spark.read.parquet(scores).select("key", "tenure", "churn_probability", "prediction")


@query
def batch_summary(spark: SparkSession, folder: str) -> DataFrame:
    return score.summary(_scored(spark, folder))


@query
def tier_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The summary per tier and contract."""
    customers = _customers(spark, folder)
    contract = F.when(F.col("Contract_Month_to_Month") == 1, "Month-to-Month").when(
        F.col("Contract_One_Year") == 1, "One Year"
    ).otherwise("Two Year")
    scored = scoring.score_linear(customers, MODEL).withColumn("contract", contract)
    return score.summary(scored, ["retention_risk", "contract"])


@query
def baseline_delta(spark: SparkSession, folder: str) -> DataFrame:
    loyal = scoring.score_linear(
        profiles.profile(spark, "loyal").withColumn("key", F.lit(0)).drop("profile"), MODEL
    )
    compared = panel.with_baseline(_scored(spark, folder), loyal)
    return compared.select(
        "key", "churn_probability", "baseline", F.round("delta", 6).alias("delta"),
        "delta_sign", "delta_text", "baseline_text",
    )


@query
def gauge(spark: SparkSession, folder: str) -> DataFrame:
    """Gauge values, also for inputs outside [0, 1]."""
    p = F.col("churn_probability") * 1.5 - 0.25
    return _scored(spark, folder).select(
        "key", F.round(panel.clamp(p), 6).alias("clamped"),
        F.round(panel.gauge_angle(p), 6).alias("angle"), panel.gauge_colour(p).alias("colour"),
    )


@query
def tier_narrative(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select(
        "key", "retention_risk", panel.narrative(F.col("retention_risk")).alias("narrative")
    )


# --- drivers ----------------------------------------------------------------------

def _driver_rows(df: DataFrame, drivers: Column | str) -> DataFrame:
    rows = df.select("key", F.posexplode_outer(drivers).alias("rank", "d"))
    return rows.filter("rank IS NOT NULL").select("key", "rank", "d.*")


@query
def drivers_top8(spark: SparkSession, folder: str) -> DataFrame:
    return _driver_rows(_explained(spark, folder), "feature_importance")


@query
def drivers_pretty(spark: SparkSession, folder: str) -> DataFrame:
    return _driver_rows(_explained(spark, folder, "pretty"), "feature_importance")


@query
def drivers_rising(spark: SparkSession, folder: str) -> DataFrame:
    """Of the top five, the drivers that push towards churn and weigh something."""
    return _driver_rows(
        _explained(spark, folder), explain.rising(F.col("feature_importance"))
    ).select("key", "rank", "feature", "magnitude")


@query
def panel_bars(spark: SparkSession, folder: str) -> DataFrame:
    return _driver_rows(_explained(spark, folder), panel.bars(F.col("feature_importance")))


@query
def explain_absent(spark: SparkSession, folder: str) -> DataFrame:
    """Drivers of records with gaps under the single-record rule: null means absent."""
    gaps = telco.with_gaps(_customers(spark, folder))
    explained = scoring.explain_linear(gaps, MODEL, null_means=encode.NULL_IS_ABSENT)
    return _driver_rows(explained, "feature_importance")


@query
def additivity_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Some records are so extreme that their probability is 1."""
    huge = F.when(F.col("key") % 40 == 3, 50_000.0).otherwise(F.col("MonthlyCharges"))
    scored = scoring.explain_linear(
        _customers(spark, folder).withColumn("MonthlyCharges", huge), MODEL)
    return explain.additivity_audit(scored).select("rows", "audited", "additive")


@query
def additivity_damaged(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without contributions are counted, and are not passed off as audited."""
    scored = MODEL.explain(_scored(spark, folder))
    phi = F.when(F.col("key") % 7 == 3, F.lit(None)).otherwise(F.col("phi"))
    audit = explain.additivity_audit(scored.withColumn("phi", phi))
    return audit.select("rows", "audited", (F.col("worst") < 1e-6).alias("within"), "additive")


@query
def importance(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh array is too short and is left out."""
    explained = MODEL.explain(_scored(spark, folder))
    phi = F.when(F.col("key") % 7 == 2, F.slice("phi", 1, 50)).otherwise(F.col("phi"))
    return explain.importance(explained.withColumn("phi", phi)).withColumn(
        "mean_size", F.round("mean_size", 12)
    )


@query
def explain_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Damaged contribution arrays: a bias at the end, a wrong width, none at all,
    non-finite entries, missing values."""
    rest = F.col("key") % 7
    phi = F.col("phi")
    infinite = F.transform(phi, lambda x, i: F.when(i % 5 == 0, F.lit(float("inf")))
                           .when(i % 5 == 1, F.lit(float("nan"))).otherwise(x))
    damaged = (
        F.when(rest == 1, F.concat(phi, F.array(F.lit(99.0))))
        .when(rest == 2, F.slice(phi, 1, 50))
        .when(rest == 3, F.lit(None))
        .when(rest == 4, infinite)
        .otherwise(phi)
    )
    values = F.transform("feature_values", lambda x: F.when(rest == 5, F.lit(float("nan"))).otherwise(x))
    explained = MODEL.explain(_scored(spark, folder)).withColumns(
        {"phi": damaged, "feature_values": values}
    )
    rows = explain.with_drivers(explained).select(
        "key", F.posexplode_outer("feature_importance").alias("rank", "d")
    )
    return rows.select("key", "rank", "d.*")


# --- actions ----------------------------------------------------------------------

@query
def driver_text(spark: SparkSession, folder: str) -> DataFrame:
    features = F.col("feature_importance")
    return _explained(spark, folder).select(
        "key",
        actions.driver_text(features).alias("reasons"),
        _text(actions.driver_tags(features)).alias("tags"),
    )


def _precautions(spark: SparkSession, folder: str, style: str) -> DataFrame:
    customers = telco.with_gaps(_customers(spark, folder))
    carried = customers.withColumn("missing", flags.missing_inputs(customers))
    scored = scoring.explain_linear(carried, MODEL, carry=("key", "missing"), style=style)
    return actions.with_precautions(scored, "missing")


@query
def precautions(spark: SparkSession, folder: str) -> DataFrame:
    return _driver_rows(_precautions(spark, folder, "faithful"), "precautions")


@query
def precautions_pretty(spark: SparkSession, folder: str) -> DataFrame:
    return _driver_rows(_precautions(spark, folder, "pretty"), "precautions")


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    return actions.with_retention_request(_precautions(spark, folder, "faithful"))


@query
def retention_request(spark: SparkSession, folder: str) -> DataFrame:
    return _requests(spark, folder).select("key", "request.*").withColumns({
        "top_drivers": _text(F.col("top_drivers")), "risk_signals": _text(F.col("risk_signals")),
    })


@query
def brief_text(spark: SparkSession, folder: str) -> DataFrame:
    """Briefs, some without a percentage, drivers or signals."""
    rest = F.col("key") % 4
    request = F.struct(
        F.col("request.risk_level").alias("risk_level"),
        F.col("request.reasons").alias("reasons"),
        F.when(rest != 1, F.col("request.top_drivers")).alias("top_drivers"),
        F.when(rest != 2, F.col("request.risk_signals")).alias("risk_signals"),
        F.when(rest != 3, F.col("request.probability_pct")).alias("probability_pct"),
    )
    shaped = _requests(spark, folder).select("key", request.alias("r"))
    return shaped.select("key", brief.brief(F.col("r")).alias("brief"))


def _conversations(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/conversations.parquet")


@query
def plan_select(spark: SparkSession, folder: str) -> DataFrame:
    """Generated texts, some missing or blank, as tagged plans."""
    turn = F.col("turn") % 4
    text = F.when(turn == 1, F.lit(None)).when(turn == 2, F.lit(" \n ")).otherwise(
        F.concat(F.lit("  "), F.col("text"), F.lit("\n"))
    )
    generated = _conversations(spark, folder).select(
        "conv_id", "turn", F.when(F.col("role") == "user", text).otherwise(F.col("text")).alias("t")
    )
    return generated.select("conv_id", "turn", brief.plan(F.col("t")).alias("plan"))


@query
def plan_tag(spark: SparkSession, folder: str) -> DataFrame:
    """Tagged texts back to badge and text."""
    turn = F.col("turn") % 5
    tagged = (
        F.when(turn == 0, F.concat(F.lit("[Action Plan] "), F.col("text")))
        .when(turn == 1, F.concat(F.lit("[Default Action Plan]\n"), F.col("text")))
        .when(turn == 2, F.concat(F.lit("[Generated by LLM] "), F.col("text")))
        .when((turn == 3) & (F.col("role") == "user"), F.lit(""))
        .when((turn == 4) & (F.col("role") == "user"), F.lit(None))
        .otherwise(F.col("text"))
    )
    texts = _conversations(spark, folder).select("conv_id", "turn", tagged.alias("t"))
    return texts.select(
        "conv_id", "turn", brief.plan_badge(F.col("t")).alias("badge"),
        brief.plan_body(F.col("t")).alias("body"),
    )


SLOTS = {"standard": "small-text-model", "high_capacity": "large-text-model"}


@query
def model_slot(spark: SparkSession, folder: str) -> DataFrame:
    """The text model each request gets, by the slot it asked for."""
    asked = F.element_at(
        F.array(*[F.lit(x) for x in ("standard", "high_capacity", " high_capacity ", "huge", None)]),
        (F.col("event_id") % 5 + 1).cast("int"),
    )
    events = spark.read.parquet(f"{folder}/events.parquet").select("event_id", asked.alias("a"))
    return events.select("event_id", brief.choose_slot(F.col("a"), SLOTS, "standard").alias("model"))


# --- training ---------------------------------------------------------------------

@query
def train_frame(spark: SparkSession, folder: str) -> DataFrame:
    table = telco.training_table(_customers(spark, folder))
    return clean.training_frame(table)[0].withColumn("Churn", F.col("Churn").cast("int"))


def _named_customers(spark: SparkSession, folder: str) -> DataFrame:
    """A training table whose only id is the text column "Customer ID"."""
    name = F.concat(F.lit("C-"), F.col("key").cast("string"))
    return telco.training_table(_customers(spark, folder)).withColumn("Customer ID", name).drop("key")


@query
def train_frame_text_key(spark: SparkSession, folder: str) -> DataFrame:
    frame = clean.training_frame(_named_customers(spark, folder), key="Customer ID")[0]
    return frame.withColumn("Churn", F.col("Churn").cast("int"))


@query
def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = clean.clean(telco.training_table(_customers(spark, folder)))
    return clean.vocabulary(cleaned, encode.numeric_and_text_columns(cleaned)[1])


@query
def target_recode(spark: SparkSession, folder: str) -> DataFrame:
    """A target under another name with values that are neither yes nor no."""
    status = F.when(F.col("key") % 10 == 0, "Joined").when(F.col("key") % 10 == 1, None).when(
        F.col("Churn") == 1, "Churned"
    ).otherwise("Stayed")
    table = _customers(spark, folder).select("key", status.alias("Status"))
    config = DataConfig(target="Status", positive="Churned", negative="Stayed")
    return clean.keep_binary_target(table, config).withColumn("Churn", F.col("Churn").cast("int"))


@query
def derived_features(spark: SparkSession, folder: str) -> DataFrame:
    """Rates, service counts from Yes/No text, age groups with values at their edges."""
    edges = F.element_at(
        F.array(*[F.lit(x) for x in (0, 30, 31, 50, 51, 70, 71, 120, 121, None)]),
        (F.col("key") % 10 + 1).cast("int"),
    ).cast("bigint")
    services = ("OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport",
                "StreamingTV", "StreamingMovies")
    table = _customers(spark, folder).withColumns(
        {n: flags.to_yes_no(F.col(n)) for n in services}
        | {"Age": F.when(F.col("key") % 3 == 0, edges).otherwise(F.col("Age"))}
    )
    return derive.derive(encode.rename_fields(table)).select(
        "key", F.col("Revenue_per_Tenure").alias("revenue_per_tenure"),
        F.col("Charges_per_Month").alias("charges_per_month"),
        F.col("Total_Services").alias("total_services"), F.col("Age_Group").alias("age_group"),
    )


@query
def parity(spark: SparkSession, folder: str) -> DataFrame:
    """Training encoder and scoring encoder on the same customers."""
    customers = _customers(spark, folder)
    trained, _ = clean.training_frame(telco.training_table(customers))
    blank = F.when(F.col("key") % 17 == 0, 0.0).otherwise(F.col("TotalCharges"))
    return clean.parity(trained, encode.features(customers.withColumn("TotalCharges", blank)))


@query
def split_sides(spark: SparkSession, folder: str) -> DataFrame:
    return split.stratified_split(_customers(spark, folder).select("key", "Churn"))


@query
def split_counts(spark: SparkSession, folder: str) -> DataFrame:
    parts = split.stratified_split(_customers(spark, folder).select("key", "Churn"))
    return parts.groupBy("Churn", "is_train").agg(F.count("*").alias("n"))


@query
def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Some rows have no label and weigh nothing."""
    label = F.when(F.col("key") % 9 != 0, F.col("Churn"))
    return split.class_weights(_customers(spark, folder).withColumn("Churn", label))


def _with_label(spark: SparkSession, folder: str) -> DataFrame:
    """Scores with their label; some of either are missing."""
    scored = scoring.score_linear(_customers(spark, folder), MODEL, carry=("key", "Churn"))
    rest = F.col("key") % 50
    score = F.when(rest == 7, float("nan")).when(rest == 8, F.lit(None)).otherwise(F.col("probability"))
    return scored.withColumns({
        "probability": score, "Churn": F.when(rest != 9, F.col("Churn"))})


@query
def auc_exact(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.roc_auc(_with_label(spark, folder)).withColumn("auc", F.round("auc", 9))


@query
def auc_ties(spark: SparkSession, folder: str) -> DataFrame:
    """The area over a coarse score, per tier: many ties, three groups."""
    steps = F.when(~F.isnan("probability"), F.floor(F.col("probability") * 20))
    coarse = _with_label(spark, folder).withColumn("coarse", steps)
    return evaluate.roc_auc(
        coarse, "Churn", "coarse", by=["retention_risk"], slices=1
    ).withColumn("auc", F.round("auc", 9))


def _customer_model(spark: SparkSession, folder: str):
    """A small model of the customer view, its training and its test part."""
    frame = encode.features(_customers(spark, folder), ("key", "Churn"))
    path = fresh_path(spark, "frame")
    split.stratified_split(frame).write.parquet(path)
    stored = spark.read.parquet(path)
    train, test = (stored.filter(F.col("is_train") == side).drop("is_train") for side in (True, False))
    return fit(train, config=SMALL), train, test


@query
def train_gbt_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The training job on generated customers: what the ledger has, the sizes of both
    sides, that it learned what is planted, and that the stored model scores every test
    row as the fitted one does."""
    table = telco.training_table(_generated(spark, folder))
    model_path, ledger_path = fresh_path(spark, "model"), fresh_path(spark, "ledger")
    result = training.train(
        spark, table, config=SMALL, model_path=model_path, ledger_path=ledger_path
    )
    again = load(spark, model_path)
    frame = _generated_features(spark, folder)
    rows = encode.align(frame, result.model.columns, ("key", "Churn"))[0]
    both = result.model.score(rows).drop("logit").withColumnRenamed("probability", "fitted")
    unequal = again.score(both).filter(~F.col("fitted").eqNullSafe(F.col("probability"))).count()
    return ledger.runs(spark, ledger_path).select(
        "experiment",
        F.col("params")["trees"].cast("int").alias("trees"),
        F.col("params")["rows"].cast("bigint").alias("labelled_rows"),
        F.col("params")["max_rows"].alias("max_rows"),
        (F.col("metrics")["roc_auc"] == F.lit(result.auc)).alias("area_logged"),
    ).withColumns({
        "train_rows": F.lit(result.train_rows).cast("bigint"),
        "test_rows": F.lit(result.test_rows).cast("bigint"),
        "unlabelled": F.lit(result.unlabelled).cast("bigint"),
        "learned": F.lit(result.auc > 0.7),
        "loss_falls": F.lit(result.losses[-1] < result.losses[0]),
        "reloaded_unequal": F.lit(unequal).cast("bigint"),
    })


@query
def tree_additivity(spark: SparkSession, folder: str) -> DataFrame:
    """Exact attributions of a fitted model add up to the margin in every test row."""
    model, _, test = _customer_model(spark, folder)
    paths = attribution.path_table(attribution.read_trees(spark, model), model.columns)
    explained = attribution.explain_trees(spark, paths, model.score(test))
    return explain.additivity_audit(explained).select("rows", "audited", "additive")


@query
def tree_importance(spark: SparkSession, folder: str) -> DataFrame:
    """Attributions of a model of generated customers: every feature is listed, in every
    row one is on top, and a planted cause leads."""
    frame = _generated_features(spark, folder)
    path = fresh_path(spark, "frame")
    frame.write.parquet(path)
    stored = spark.read.parquet(path)
    model = fit(stored, config=SMALL)
    paths = attribution.path_table(attribution.read_trees(spark, model), model.columns)
    explained = attribution.explain_trees(spark, paths, model.score(stored))
    found = explain.importance(explained, model.columns)
    planted = ("Satisfaction_Score", "Contract_Month_to_Month", "Tenure_in_Months")
    leads = F.max_by("column", "mean_size").isin(*planted)
    return found.agg(F.count("*").alias("features"), F.sum("rows_on_top").alias("rows"),
                     leads.alias("planted_leads"))


@query
def gbt_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """After each tree, on the test part: counts of both classes, and whether the loss is
    the one the trees' own scores give."""
    model, _, test = _customer_model(spark, folder)
    losses = losses_by_round(model, test)
    staged = attribution.staged_scores(
        spark, attribution.read_trees(spark, model), model.columns, test
    )
    own = staged.groupBy("round").agg(F.avg(-F.ln(F.when(
        F.col("Churn") == 1, F.col("probability")).otherwise(1 - F.col("probability")))).alias("own"))
    areas = evaluate.roc_auc(staged, "Churn", "probability", by=["round"])
    listed = F.array(*[F.lit(x) for x in losses])
    # MLlib's loss is 2 log(1 + exp(-2 y m)): twice the log-loss of its probability.
    loss = F.get(listed, F.col("round") - 1)
    return areas.join(own, "round").select(
        "round", "positives", "negatives", F.col("auc").between(0, 1).alias("area_valid"),
        (F.abs(loss / 2 - F.col("own")) < 1e-9).alias("loss_agrees"),
    )


# Columns with few values, so that any engine finds the same bins; three leaves a tree.
FEW_VALUES = tuple(c for c in FEATURE_COLUMNS if c not in {
    f.column for f in FIELDS if f.kind == MONEY} | {"CLTV", "Avg_Monthly_GB_Download"})
THREE_LEAVES = ModelConfig(trees=3, depth=2, leaves=3, step=0.3, l2=0.5)


def _sides(spark: SparkSession, folder: str) -> DataFrame:
    """The encoded customer view with its two sides, stored."""
    frame = encode.features(_customers(spark, folder), ("key", "Churn"))
    path = fresh_path(spark, "sides")
    split.stratified_split(frame).write.parquet(path)
    return spark.read.parquet(path)


@query
def target_split(spark: SparkSession, folder: str) -> DataFrame:
    """Features and target of the encoded customers: both keep the key, no feature is lost."""
    frame = encode.features(_customers(spark, folder), ("key", "Churn"))
    features, target = encode.split_target(frame, "Churn")
    joined = features.join(target, "key")
    total = sum(F.col(c).cast("decimal(38,6)") for c in FEATURE_COLUMNS)
    return joined.select("key", "Churn", F.lit(len(features.columns) - 1).alias("features"),
                         total.cast("double").alias("feature_sum"))


@query
def field_map(spark: SparkSession, folder: str) -> DataFrame:
    """Every field of the contract by its three names, and how many customers have it."""
    check_contract()
    known = _customers(spark, folder).agg(*[F.count(f.name).alias(f.name) for f in FIELDS])
    rows = F.array(*[F.struct(
        F.lit(f.name).alias("field"), F.lit(f.dataset).alias("dataset"),
        F.lit(f.column).alias("column"), F.col(f.name).alias("customers")) for f in FIELDS])
    return known.select(F.inline(rows))


@query
def boosted_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of leaf-wise trees of the customer view: tests, rows and Newton values."""
    train = _sides(spark, folder).where("is_train")
    model = leafwise.fit(train, FEW_VALUES, config=THREE_LEAVES)
    names = F.array(*[F.lit(c) for c in FEW_VALUES])
    return leafwise.node_table(spark, model).select(
        (F.col("tree") + 1).alias("tree"), "node",
        F.when(F.col("feature") >= 0, F.get(names, F.col("feature"))).alias("feature"),
        "threshold", F.round("value", 9).alias("value"), F.col("rows").cast("bigint").alias("rows"))


@query
def boosted_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """The training job as configured, 300 trees of up to 31 leaves, on the customer view: after
    each round what the ledger has, and the training rows in the leaves of its tree."""
    ledger_path = fresh_path(spark, "ledger")
    table = telco.training_table(_customers(spark, folder))
    model, ready = training.train_leafwise(spark, table, ledger_path=ledger_path)
    leaves = leafwise.node_table(spark, model).where("feature < 0").groupBy("tree").agg(
        F.sum("rows").cast("bigint").alias("train_rows"), F.count("*").alias("leaves"))
    logged = ledger.runs(spark, ledger_path).select(F.explode("metrics").alias("name", "area"))
    areas = logged.where("name LIKE 'roc_auc_%'").select(
        F.substring_index("name", "_", -1).cast("int").alias("round"), "area")
    losses = F.array(*[F.lit(x) for x in model.losses])
    return leaves.join(areas, F.col("round") == F.col("tree") + 1).select(
        "round", "train_rows", F.lit(ready.sizes.get(False, 0)).cast("bigint").alias("test_rows"),
        F.col("leaves").between(1, 31).alias("few_leaves"),
        F.col("area").between(0, 1).alias("area_logged"),
        (F.get(losses, F.col("tree")) > 0).alias("loss_taken"))


@query
def deep_additivity(spark: SparkSession, folder: str) -> DataFrame:
    """Attributions of trees of up to twelve levels add up to the log-odds of every row."""
    config = ModelConfig(trees=2, depth=12, leaves=40, step=0.3, least_rows=2)
    rows = _sides(spark, folder)
    model = leafwise.fit(rows.where("is_train"), config=config)
    paths = attribution.path_table(model.ensemble(), model.columns)
    explained = attribution.explain_trees(spark, paths, model.score(rows))
    return explain.additivity_audit(explained).select("rows", "audited", "additive")


# A small ensemble on the log-odds scale, for attributions any engine can recompute.
def _stump_forest() -> list[tuple[float, dict[int, Node]]]:
    c = {name: i for i, name in enumerate(FEATURE_COLUMNS)}
    satisfaction, tenure = c["Satisfaction_Score"], c["Tenure_in_Months"]
    monthly, contract = c["Contract_Month_to_Month"], c["Monthly_Charge"]
    first = {n.id: n for n in (
        Node(0, 0.0, 1000, 1, 2, satisfaction, 2.5),
        Node(1, 0.0, 380, 3, 4, tenure, 24.0),
        Node(2, 0.0, 620, 5, 6, monthly, 0.5),
        Node(3, 2.1, 130), Node(4, 1.2, 250), Node(5, -1.7, 300),
        Node(6, 0.0, 320, 7, 8, satisfaction, 4.5),
        Node(7, -0.2, 220), Node(8, -1.1, 100),
    )}
    second = {n.id: n for n in (
        Node(0, 0.0, 1000, 1, 2, contract, 70.0),
        Node(1, -0.4, 520),
        Node(2, 0.0, 480, 3, 4, tenure, 12.0),
        Node(3, 0.9, 60),
        Node(4, 0.0, 420, 5, 6, contract, 95.0),
        Node(5, 0.1, 250), Node(6, 0.45, 170),
    )}
    return [(1.0, first), (0.5, second)]


FOREST = _stump_forest()


@query
def tree_drivers(spark: SparkSession, folder: str) -> DataFrame:
    """Attributions of a small fixed ensemble for every customer."""
    paths = attribution.path_table(FOREST, FEATURE_COLUMNS)
    frame = encode.features(_customers(spark, folder))
    explained = explain.with_drivers(attribution.explain_trees(spark, paths, frame))
    return _driver_rows(explained, "feature_importance").withColumn("bias", F.lit(round(paths.bias, 9)))


# --- sources and sinks ------------------------------------------------------------

@query
def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "csv")
    files.write_csv(_customers(spark, folder).drop("Churn"), path)
    return files.read_csv(spark, path, files.keyed_schema())


@query
def json_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "json")
    _customers(spark, folder).drop("Churn").write.json(path)
    return files.read_json(spark, path)


@query
def score_json_output(spark: SparkSession, folder: str) -> DataFrame:
    """Nested score records through JSON files, one row per driver."""
    path = fresh_path(spark, "scores")
    files.write_scores_json(_explained(spark, folder), path)
    kept = "key bigint, prediction int, churn_probability double, retention_risk string, " \
           "feature_importance array<struct<feature:string,value:double,magnitude:double,direction:string>>"
    back = spark.read.schema(kept).json(path)
    return back.select(
        "key", "prediction", "churn_probability", "retention_risk",
        F.posexplode_outer("feature_importance").alias("rank", "d"),
    ).select("*", "d.*").drop("d")


@query
def training_load(spark: SparkSession, folder: str) -> DataFrame:
    """A large training CSV: all rows. One generated customer per line item."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    line = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000 + F.col("l_partkey") % 1000
    keys = lines.select(line.alias("key")).distinct()
    path = fresh_path(spark, "csv")
    files.write_csv(generator.customers_for(keys), path)
    return files.load_training_csv(spark, path, "key", files.keyed_schema()).select(
        "key", "Gender", "tenure", "MonthlyCharges"
    )


@query
def fit_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The rows a fit is bounded to on request: the first 500 by a text key."""
    frame = clean.training_frame(_named_customers(spark, folder), key="Customer ID")[0]
    return files.first_rows(frame, "key", 500).select("key", F.col("Churn").cast("int").alias("Churn"))


@query
def synth_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Generated customers, one per order, counted and measured per contract."""
    return _generated(spark, folder).groupBy("Contract").agg(
        F.count("*").alias("n"),
        F.sum("tenure").alias("tenure"),
        F.min("Age").alias("youngest"), F.max("Age").alias("oldest"),
        F.sum("SatisfactionScore").alias("satisfaction"),
        F.sum(F.col("MonthlyCharges").cast("decimal(18,2)")).cast("double").alias("charges"),
        F.count_if(F.col("Offer") == "None").alias("no_offer"),
        F.count_if(F.col("InternetType") == "Fiber Optic").alias("fiber"),
        F.sum("Churn").alias("gone"),
    )


# --- streams ----------------------------------------------------------------------

def _arrived(spark: SparkSession, folder: str) -> str:
    path = fresh_path(spark, "arrived")
    telco.damaged_records(_customers(spark, folder)).write.parquet(path)
    return path


def _stream_scores(spark: SparkSession, folder: str) -> tuple[str, str]:
    scores, rejected = fresh_path(spark, "scores"), fresh_path(spark, "quarantine")
    stream.finish(stream.start_scoring(
        stream.record_stream(spark, _arrived(spark, folder)),
        lambda valid: scoring.records(
            scoring.explain_linear(valid, MODEL, null_means=encode.NULL_IS_ABSENT)),
        scores, rejected, fresh_path(spark, "checkpoint"),
    ))
    return scores, rejected


@query
def stream_score(spark: SparkSession, folder: str) -> DataFrame:
    scores, _ = _stream_scores(spark, folder)
    first = F.get("feature_importance", F.lit(0))
    return spark.read.parquet(scores).select(
        "key", "prediction", "churn_probability", "retention_risk",
        first["feature"].alias("first_driver"), F.size("feature_importance").alias("n_drivers"),
    )


@query
def stream_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    _, rejected = _stream_scores(spark, folder)
    return spark.read.parquet(rejected).select("key", _text(F.col("errors")).alias("errors"))


@query
def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Records taken in as they arrive."""
    target = fresh_path(spark, "ingested")
    rows = stream.record_stream(spark, _arrived(spark, folder), files_per_batch=2)
    stream.finish(stream.start_ingest(rows, target, fresh_path(spark, "checkpoint")))
    return stream.ingested(spark, target, "key")


@query
def stream_capped(spark: SparkSession, folder: str) -> DataFrame:
    """Records taken in until there are 1,000: how many, of how many customers."""
    target, checkpoint = fresh_path(spark, "capped"), fresh_path(spark, "checkpoint")
    rows = stream.record_stream(spark, _arrived(spark, folder), files_per_batch=1)
    taken = stream.CappedIngest(rows, target, checkpoint, "key", 1000).run()
    return stream.ingested(spark, target, "key").agg(
        F.count("*").alias("rows"), F.count_distinct("key", "raw").alias("records")).withColumn(
        "counted", F.lit(taken).cast("bigint"))


def _request_log(events: DataFrame) -> DataFrame:
    return events.select("ts", F.col("user_id").alias("client"))


def _log_lines(events: DataFrame) -> DataFrame:
    """The events as JSON log lines: path = event type, latency = an eighth of the value,
    so with more decimals. Some have no latency, some cannot be read."""
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    latency = F.when(F.col("event_id") % 11 != 0, F.col("value") / 8)
    line = F.to_json(F.struct(
        F.lit("POST").alias("method"), F.col("event_type").alias("path"),
        status.alias("status"), latency.alias("latency_ms"),
    ))
    rest = F.col("event_id") % 13
    damaged = F.when(rest == 1, '{"path":').when(rest == 2, '{"status":200}').when(
        rest == 3, F.lit(None)).otherwise(line)
    return events.select("ts", damaged.alias("line"))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    # As a pattern the path may be one file or a folder of part files.
    schema = _events(spark, folder).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/events.parque[t]")


def _stamped(df: DataFrame) -> DataFrame:
    return df.withColumns({
        c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        for c in df.columns if c.startswith("window_")
    })


@query
def rate_breach(spark: SparkSession, folder: str) -> DataFrame:
    return _stamped(requests.request_counts(_request_log(_events(spark, folder))))


@query
def rate_breach_daily(spark: SparkSession, folder: str) -> DataFrame:
    """The same count by day against the smallest limit, where limits do get exceeded."""
    return _stamped(requests.request_counts(
        _request_log(_events(spark, folder)), requests.PLAN_LIMIT, "1 day"
    ))


@query
def rate_breach_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The daily count as a stream: the windows the watermark has closed."""
    arriving = requests.with_lateness(_request_log(_event_stream(spark, folder)))
    counted = requests.request_counts(arriving, requests.PLAN_LIMIT, "1 day")
    target = fresh_path(spark, "breaches")
    stream.finish(requests.start_table(counted, target, fresh_path(spark, "checkpoint")))
    return _stamped(spark.read.parquet(target))


@query
def stream_still_open(spark: SparkSession, folder: str) -> DataFrame:
    """What the daily stream above does not return yet."""
    return requests.still_open(_events(spark, folder), "1 day")


@query
def log_summary(spark: SparkSession, folder: str) -> DataFrame:
    lines = requests.parse_log(_log_lines(_events(spark, folder)))
    return _stamped(requests.log_summary(lines))


@query
def log_unreadable(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that are no requests, per line."""
    lines = requests.unreadable_log(_log_lines(_events(spark, folder)))
    return lines.groupBy("line").agg(F.count("*").alias("n"))


@query
def log_summary_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The hourly summary as a stream: the windows the watermark has closed."""
    arriving = requests.with_lateness(_log_lines(_event_stream(spark, folder)))
    summary = requests.log_summary(requests.parse_log(arriving), "1 hour")
    target = fresh_path(spark, "summary")
    stream.finish(requests.start_table(summary, target, fresh_path(spark, "checkpoint")))
    return _stamped(spark.read.parquet(target))


def _closed_minutes(spark: SparkSession, folder: str) -> DataFrame:
    """The minute table that a stream has written."""
    # Only lines that can be read move the watermark.
    arriving = requests.with_lateness(requests.parse_log(_log_lines(_event_stream(spark, folder))))
    target = fresh_path(spark, "minutes")
    stream.finish(requests.start_table(
        rollups.minutes(arriving), target, fresh_path(spark, "checkpoint")))
    return spark.read.parquet(target)


@query
def latency_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Days of hours of the minutes that a stream's watermark has closed."""
    hours = rollups.rolled(_closed_minutes(spark, folder), "1 hour")
    return _stamped(rollups.summary(rollups.rolled(hours, "1 day")))


@query
def latency_rank_error(spark: SparkSession, folder: str) -> DataFrame:
    """Latencies in the sketches of weeks merged from minutes, and whether the true rank of
    each estimate is within the stated bound."""
    lines = requests.parse_log(_log_lines(_events(spark, folder)))
    weeks = rollups.rolled(rollups.minutes(lines), "7 days")
    held = weeks.select(F.col("minute").alias("window_start"), "path",
                        F.kll_sketch_get_n_double("sketch").alias("timed"))
    errors = rollups.rank_errors(weeks, lines, "7 days", (0.5, 0.95, 0.99))
    return _stamped(errors.join(held, ["window_start", "path"]).select(
        "window_start", "path", "rank", "timed",
        (F.col("error") <= rollups.RANK_ERROR).alias("within")))


@query
def onehot_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Orders by customer, day and priority as sparse rows: of every indicator its rows and
    their order keys, and the width."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    columns = ["customer", "day", "priority"]
    rows = orders.select(
        "o_orderkey", F.when(F.col("o_custkey") % 7 != 0, F.concat(
            F.lit("c"), F.col("o_custkey"))).alias("customer"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.col("o_orderpriority").alias("priority"))
    words = indicators.learn(rows, columns)
    encoded = indicators.encode(rows, words, columns, "o_orderkey")
    sums = encoded.select("o_orderkey", F.explode("indices").alias("number")).groupBy(
        "number").agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))
    width = words.agg(F.max("number") + 1).scalar()
    return words.join(sums, "number").select("column", "value", "rows", "keys",
                                             width.alias("width"))
