"""Rules over analysed images of risk-control plans.

Images are rows (doc_id, chunk_id, image_type, analysis) with the analysis as JSON text. A rule is a
condition on the parsed analysis; what it finds are rows of findings, folded to a verdict by a ladder.
Analyses that do not parse count as empty. A document without an image of the types is uncertain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.lexicons import AREA_WORDS, FORBIDDEN_OBSTACLES, SIGNING_ORDER, SIGNING_ROLES_REQUIRED

ANALYSIS = (
    "signatures array<struct<role:string,name_present:boolean,date:string>>, pipeline_visible boolean, pipeline_solid_line boolean, impact_radius_dashed boolean, "
    "three_parallel_lines boolean, buildings array<struct<label:string,distance_marked:boolean>>, route_marked boolean, crosses_obstacles array<string>, vehicle_accessible boolean, "
    "text_description_present boolean, evacuation_arrows_present boolean, follows_pipeline_direction boolean, evacuates_to_both_sides boolean, assembly_points_count int, "
    "outside_impact_radius boolean, water_body_visible boolean, containment_facility_marked boolean, facility_position_appropriate boolean, crossing_marked boolean, "
    "crossing_count int, depth_marked boolean"
)
TYPES = {
    "I1_signature": ["approval"], "I3_aerial": ["hca_aerial"], "I4_entry_route": ["entry_route"], "I5_evacuation": ["evacuation_route", "assembly_point"],
    "I6_water_containment": ["water_containment"], "I7_municipal_crossing": ["municipal_crossing"],
}


def _no(name: str) -> Column:
    """The field is missing, null or false."""
    return ~F.coalesce(F.col(f"a.{name}"), F.lit(False))


def _denied(name: str) -> Column:
    """The field is false; missing counts as true."""
    return ~F.coalesce(F.col(f"a.{name}"), F.lit(True))


def _rule(name: str, severity: str, times: Column) -> Column:
    """As many findings as `times`, a number or a condition."""
    return F.struct(F.lit(name).alias("rule_id"), F.lit(severity).alias("severity"), times.cast("int").alias("times"))


def _rules(dimension: str) -> list[Column]:
    size = lambda name: F.greatest(F.size(F.coalesce(F.col(f"a.{name}"), F.array())), F.lit(0))
    match dimension:
        case "I1_signature":
            signed = F.transform(F.filter("a.signatures", lambda s: F.coalesce(s["name_present"], F.lit(False))), lambda s: s["role"])
            some = size("signatures") > 0
            later = [F.coalesce(F.try_element_at(_dated(early), F.lit(-1)) > F.try_element_at(_dated(late), F.lit(-1)), F.lit(False)) for early, late in SIGNING_ORDER]
            return [
                _rule("I1.no_signature", "high", ~some),
                *[_rule("I1.missing_role", "medium", some & ~F.array_contains(F.coalesce(signed, F.array().cast("array<string>")), role)) for role in SIGNING_ROLES_REQUIRED],
                *[_rule("I1.date_sequence", "high", x) for x in later],
            ]
        case "I3_aerial":
            bare = F.size(F.filter(F.coalesce("a.buildings", F.array().cast("array<struct<label:string,distance_marked:boolean>>")), lambda b: ~F.coalesce(b["distance_marked"], F.lit(False))))
            return [
                _rule("I3.no_pipeline", "high", _no("pipeline_visible")), _rule("I3.no_solid_line", "medium", _no("pipeline_solid_line")),
                _rule("I3.no_dashed_radius", "medium", _no("impact_radius_dashed")), _rule("I3.no_three_lines", "low", _no("three_parallel_lines")),
                _rule("I3.no_buildings", "medium", size("buildings") == 0), _rule("I3.building_no_distance", "low", bare),
            ]
        case "I4_entry_route":
            crossed = F.size(F.filter(F.coalesce("a.crosses_obstacles", F.array().cast("array<string>")), lambda o: tx.any_of(o, FORBIDDEN_OBSTACLES)))
            return [
                _rule("I4.no_route", "high", _no("route_marked")), _rule("I4.forbidden_obstacle", "high", crossed),
                _rule("I4.no_vehicle", "medium", _denied("vehicle_accessible")), _rule("I4.no_text", "low", _denied("text_description_present")),
            ]
        case "I5_evacuation":
            route, point = F.col("image_type") == "evacuation_route", F.col("image_type") == "assembly_point"
            along = ~_no("follows_pipeline_direction")
            return [
                _rule("I5.no_arrows", "high", route & _no("evacuation_arrows_present")), _rule("I5.wrong_direction", "high", route & along),
                _rule("I5.not_both_sides", "medium", route & ~along & _denied("evacuates_to_both_sides")),
                _rule("I5.no_assembly", "high", point & (F.coalesce("a.assembly_points_count", F.lit(0)) == 0)),
                _rule("I5.assembly_in_radius", "high", point & _denied("outside_impact_radius")),
            ]
        case "I6_water_containment":
            return [
                _rule("I6.no_water", "medium", _no("water_body_visible")), _rule("I6.no_facility", "high", _no("containment_facility_marked")),
                _rule("I6.bad_position", "high", _denied("facility_position_appropriate")),
            ]
        case "I7_municipal_crossing":
            return [
                _rule("I7.no_crossing", "high", _no("crossing_marked")), _rule("I7.no_text", "medium", _denied("text_description_present")),
                _rule("I7.no_depth", "low", _no("depth_marked")),
            ]
    raise ValueError(f"no image rules for {dimension}")


def parsed_date(text: Column) -> Column:
    """A date in any of four notations, or null."""
    return F.coalesce(*[F.try_to_date(F.trim(text), f) for f in ("yyyy-M-d", "yyyy/M/d", "yyyy年M月d日", "yyyy.M.d")])


def _dated(role: str) -> Column:
    """The dates beside a role's signatures, in order."""
    dates = F.transform(F.filter("a.signatures", lambda s: s["role"] == role), lambda s: parsed_date(s["date"]))
    return F.filter(dates, lambda d: d.isNotNull())


def analysed(images: DataFrame, types: list[str] | None = None) -> DataFrame:
    """The images of the types, with their analysis parsed as column a."""
    rows = images if types is None else images.where(F.col("image_type").isin(*types))
    return rows.withColumn("a", F.coalesce(F.from_json("analysis", ANALYSIS), F.from_json(F.lit("{}"), ANALYSIS)))


def image_findings(images: DataFrame, dimension: str) -> DataFrame:
    """(doc_id, chunk_id, rule_id, severity): one row for each finding."""
    rules = F.filter(F.array(*_rules(dimension)), lambda r: r["times"] > 0)
    rows = analysed(images, TYPES[dimension]).select("doc_id", "chunk_id", F.explode(rules).alias("r"))
    return rows.select("doc_id", "chunk_id", "r.rule_id", "r.severity", F.explode(F.expr("sequence(1, r.times)"))).drop("col")


def image_results(images: DataFrame, docs: DataFrame, dimension: str) -> DataFrame:
    """(doc_id, dimension, verdict, score, confidence, need_review, n_images) of docs (doc_id, and hca_type for I6 and I7)."""
    rows = analysed(images, TYPES[dimension])
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    seen = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_images"), any_of(F.col("a.pipeline_visible")).alias("pipeline"), any_of(F.col("a.route_marked")).alias("route"),
        any_of(F.col("a.containment_facility_marked")).alias("facility"), F.sum(F.size(F.coalesce("a.signatures", F.array().cast("array<struct<role:string,name_present:boolean,date:string>>")))).alias("signatures"),
        F.count_if(F.col("image_type") == "evacuation_route").alias("routes"), F.coalesce(F.sum(F.when(F.col("image_type") == "assembly_point", F.col("a.assembly_points_count"))), F.lit(0)).alias("points"))
    count = lambda s: F.count_if(F.col("severity") == s).alias(s)
    found = image_findings(images, dimension).groupBy("doc_id").agg(count("high"), count("medium"), count("low"))
    joined = docs.join(seen, "doc_id", "left").join(found, "doc_id", "left").na.fill(0, ["n_images", "high", "medium", "low"])
    high, some = F.col("high") > 0, F.col("high") + F.col("medium") + F.col("low") > 0
    kind = F.col("hca_type") if "hca_type" in docs.columns else F.lit(None).cast("string")
    none = F.col("n_images") == 0
    cases: list[tuple[Column, tuple[str, int, int, bool]]] = []
    if dimension == "I6_water_containment":
        cases.append((kind != "water_sensitive", ("uncertain", 0, 80, False)))
    if dimension == "I7_municipal_crossing":
        cases.append((none & (kind == "population_intensive"), ("fail", 0, 80, True)))
        cases.append((none, ("uncertain", 0, 80, True)))
    cases.append((none, ("uncertain", 0, 15, True)))
    cases += {
        "I1_signature": [(F.col("signatures") == 0, ("fail", 0, 80, True)), (high, ("fail", 5, 80, False)), (some, ("partial", 8, 75, False))],
        "I3_aerial": [(~F.col("pipeline"), ("fail", 4, 75, False)), (high, ("fail", 5, 80, False)), (F.col("medium") >= 2, ("partial", 8, 75, False)), (some, ("partial", 10, 80, False))],
        "I4_entry_route": [(~F.col("route"), ("fail", 3, 80, False)), (high, ("fail", 5, 80, False)), (some, ("partial", 9, 75, False))],
        "I5_evacuation": [((F.col("routes") == 0) & (F.col("points") == 0), ("fail", 2, 80, True)), (high, ("fail", 5, 80, False)), (some, ("partial", 9, 75, False))],
        "I6_water_containment": [(~F.col("facility"), ("fail", 3, 75, False)), (high, ("fail", 5, 80, False)), (some, ("partial", 9, 75, False))],
        "I7_municipal_crossing": [(high, ("fail", 5, 80, False)), (some, ("partial", 9, 75, False))],
    }[dimension]
    names = (("verdict", "string"), ("score", "long"), ("confidence", "long"), ("need_review", "boolean"))
    rest = ("pass", 12, 90, False)
    ladder = [tx.first_match(F.lit(None), [(test, F.lit(v[i])) for test, v in cases], F.lit(rest[i])).cast(t).alias(name) for i, (name, t) in enumerate(names)]
    return joined.select("doc_id", F.lit(dimension).alias("dimension"), *ladder, F.col("n_images").cast("long").alias("n_images"))


def area_description(chunks: DataFrame, most: int = 8, words: list[str] = AREA_WORDS, titles: list[str] = AREA_WORDS) -> DataFrame:
    """(doc_id, n_rows, text): the first rows whose text or title names the high-consequence area, joined."""
    named = tx.any_of(F.col("content"), words) | tx.any_of(F.coalesce("title", F.lit("")), titles)
    rows = chunks.where((F.trim("content") != "") & named).groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", F.trim("content").alias("t")))), 1, most).alias("r"))
    return rows.select("doc_id", F.size("r").cast("long").alias("n_rows"), F.array_join(F.transform("r", lambda x: x["t"]), "\n---\n").alias("text"))


def image_text_gate(docs: DataFrame, images: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, ready, confidence, text): whether a document has an aerial image and a description to compare."""
    aerial = images.where("image_type = 'hca_aerial'").select("doc_id").distinct().withColumn("aerial", F.lit(True))
    rows = docs.select("doc_id").join(aerial, "doc_id", "left").join(area_description(chunks), "doc_id", "left")
    ready = F.col("aerial").isNotNull() & F.col("text").isNotNull()
    return rows.select("doc_id", ready.alias("ready"), F.when(F.col("aerial").isNull(), 15).when(F.col("text").isNull(), 20).cast("long").alias("confidence"), "text")


def checklist_answers(images: DataFrame, answers: str = "answers") -> DataFrame:
    """(doc_id, n_images, n_issues, confidence, verdict, score, need_review) of a generic checklist rater.

    `answers` maps the items to true, false, unsure or a description; `confidence` is between 0 and 1.
    """
    bad = lambda v: (F.lower(v) == "false") | F.lower(v).contains("uncertain")
    issues = F.size(F.map_filter(answers, lambda k, v: (k != "confidence") & F.coalesce(bad(v), F.lit(False))))
    sure = F.floor(F.coalesce(F.try_element_at(answers, F.lit("confidence")).cast("double"), F.lit(0.7)) * 100)
    rows = images.where(f"{answers} is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_images"), F.sum(issues).alias("n_issues"), F.floor(F.avg(sure)).alias("confidence"))
    verdict = F.when(F.col("n_issues") == 0, "pass").when(F.col("confidence") >= 60, "partial").otherwise("fail")
    return rows.select("*", verdict.alias("verdict"), F.greatest(F.lit(0), 12 - 2 * F.col("n_issues")).cast("long").alias("score"), (F.col("confidence") < 60).alias("need_review"))


def union_results(results: list[DataFrame]) -> DataFrame:
    """The results of several dimensions as one relation."""
    return reduce(lambda a, b: a.unionByName(b), results)
