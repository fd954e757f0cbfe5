"""Clinical rule lookups over small tables of rules. The tables are data of the engine's tests, not medical advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.normalize import clinical_key
from textloom.operators.fuzzy import small

# The rules as other systems have them.
INTERACTIONS = [("warfarin", "aspirin", "major", "systematic_review"), ("metformin", "contrast_dye", "major", "expert_opinion"), ("ssri", "tramadol", "major", "cohort_study"), ("amlodipine", "simvastatin", "moderate", "randomised_trial")]
CONTRAINDICATIONS = [("nsaid", "peptic_ulcer", "contraindicated"), ("metformin", "renal_failure", "contraindicated"), ("beta_blocker", "asthma", "major")]
INTERACTION_TEXTS = [
    ("warfarin", "aspirin", "Antiplatelet + anticoagulant synergism increases bleeding risk.", "Increased risk of gastrointestinal and intracranial bleeding.", "Avoid combination. If unavoidable, monitor INR closely.", "ACC/AHA Guideline 2023"),
    ("metformin", "contrast_dye", "Contrast-induced nephropathy can precipitate lactic acidosis.", "Risk of lactic acidosis in patients with renal impairment.", "Hold metformin 48 h before and after contrast study; check eGFR.", "ESUR Contrast Media Guidelines 2023"),
    ("ssri", "tramadol", "Serotonin syndrome risk – both increase CNS serotonin.", "Serotonin syndrome: agitation, hyperthermia, rigidity.", "Avoid combination. Use alternative analgesics.", "FDA Drug Safety Communication"),
    ("amlodipine", "simvastatin", "CYP3A4 inhibition increases simvastatin levels.", "Increased risk of myopathy and rhabdomyolysis.", "Limit simvastatin to 20 mg/day when used with amlodipine.", "MHRA Drug Safety Update"),
]
CONTRAINDICATION_TEXTS = [
    ("nsaid", "peptic_ulcer", "NSAIDs increase gastric mucosal injury and bleeding risk.", "تزيد مضادات الالتهاب غير الستيرويدية من خطر إصابة الغشاء المخاطي المعدي والنزيف.", "Use acetaminophen or a COX-2 selective inhibitor with PPI co-therapy."),
    ("metformin", "renal_failure", "Risk of lactic acidosis in advanced renal impairment.", "خطر الحماض اللبني في حالات القصور الكلوي المتقدم.", "Switch to insulin or sulfonylurea."),
    ("beta_blocker", "asthma", "Can cause bronchoconstriction by blocking β2 receptors.", "يمكن أن يسبب تضيق القصبات عن طريق حصار مستقبلات بيتا 2.", "Use cardioselective beta-blocker (e.g. Bisoprolol) with caution."),
]
DOSAGES = [("amoxicillin", 25.0, 50.0, 1500.0), ("paracetamol", 10.0, 15.0, 4000.0), ("ibuprofen", 5.0, 10.0, 1200.0)]
SEVERITIES = ["contraindicated", "major", "moderate", "minor"]
SYMPTOMS = [
    ("headache", "migraine", 0.35), ("headache", "tension_headache", 0.30), ("headache", "sinusitis", 0.15), ("headache", "meningitis", 0.05),
    ("fever", "upper_respiratory_infection", 0.40), ("fever", "influenza", 0.25), ("fever", "urinary_tract_infection", 0.15), ("fever", "meningitis", 0.05),
    ("chest_pain", "acute_coronary_syndrome", 0.20), ("chest_pain", "pulmonary_embolism", 0.10), ("chest_pain", "gastroesophageal_reflux", 0.25),
    ("neck_stiffness", "meningitis", 0.40), ("neck_stiffness", "cervical_spondylosis", 0.30), ("neck_stiffness", "torticollis", 0.15),
    ("dyspnea", "heart_failure", 0.25), ("dyspnea", "copd", 0.20), ("dyspnea", "asthma", 0.20), ("dyspnea", "pneumonia", 0.15),
    ("الصداع", "migraine", 0.35), ("الصداع", "tension_headache", 0.30), ("الصداع", "sinusitis", 0.15),
    ("الحمى", "upper_respiratory_infection", 0.40), ("الحمى", "influenza", 0.25), ("الحمى", "urinary_tract_infection", 0.15),
]
DRUGS = ["warfarin", "aspirin", "amoxicillin", "paracetamol", "ibuprofen", "metformin", "amlodipine", "simvastatin", "lisinopril", "losartan", "sertraline", "tramadol", "insulin", "omeprazole"]
CLASSES = [("sertraline", "ssri"), ("ibuprofen", "nsaid"), ("aspirin", "nsaid")]
CONDITIONS = ["hypertension", "diabetes", "heart failure", "asthma", "copd", "peptic ulcer", "renal failure", "migraine", "meningitis"]
PROTOCOLS = [
    ("hypertension", "I10", ["Lifestyle modifications", "Initiate ACE inhibitor or ARB", "Dual therapy"], ["Lisinopril", "Amlodipine", "Hydrochlorothiazide"]),
    ("diabetes", "E11", ["Lifestyle interventions", "Metformin (first-line therapy)", "Add SGLT2 inhibitor or GLP-1 agonist"], ["Metformin", "Empagliflozin", "Semaglutide"]),
]
ROUTES = [("interaction", "interaction|interact|تداخل|تفاعل"), ("dosage", "dose|dosage|جرعه|مقدار"), ("contraindication", "contraindication|contraindicated|موانع|مضاد"), ("treatment", "treatment|treat|manage|علاج|اداره")]


def interactions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INTERACTIONS, "a string, b string, severity string, evidence string")


def contraindications(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONTRAINDICATIONS, "drug string, condition string, severity string")


def interaction_texts(spark: SparkSession) -> DataFrame:
    """(a, b, mechanism, effect, management, source), names in their order."""
    return spark.createDataFrame([(*sorted(r[:2]), *r[2:]) for r in INTERACTION_TEXTS], "a string, b string, mechanism string, effect string, management string, source string")


def contraindication_texts(spark: SparkSession) -> DataFrame:
    """(drug, condition, details, details_ar, alternative), with spaces as the lookup has them."""
    return spark.createDataFrame([(r[0].replace("_", " "), r[1].replace("_", " "), *r[2:]) for r in CONTRAINDICATION_TEXTS], "drug string, condition string, details string, details_ar string, alternative string")


def with_texts(found: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """found with what the rules say beside their severity; null where they say nothing."""
    return found.join(texts, keys, "left")


def dosages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOSAGES, "drug string, low double, high double, cap double")


def symptoms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, i) for i, r in enumerate(SYMPTOMS)], "symptom string, condition string, weight double, ordinal int")


def protocols(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, i) for i, r in enumerate(PROTOCOLS)], "condition string, icd10 string, steps array<string>, medications array<string>, ordinal int")


def severity_rank(x: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), x)


def drug_interactions(lists: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, a, b, severity, evidence) for every pair of a list's drugs (id, drugs array) that a rule names, in either order."""
    rows = lists.select("id", F.posexplode(F.transform("drugs", lambda d: F.lower(clinical_key(d)))).alias("i", "drug"))
    pairs = rows.alias("x").join(rows.alias("y"), (F.col("x.id") == F.col("y.id")) & (F.col("x.i") < F.col("y.i"))).select(F.col("x.id").alias("id"), F.least("x.drug", "y.drug").alias("a"), F.greatest("x.drug", "y.drug").alias("b"))
    keyed = small(rules.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "severity", "evidence"))
    return pairs.distinct().join(keyed, ["a", "b"]).select("id", "a", "b", "severity", "evidence")


def worst_severity(found: DataFrame) -> DataFrame:
    rank = F.min(severity_rank(F.col("severity")))
    return found.groupBy("id").agg(F.count("*").alias("interactions"), F.element_at(F.array(*map(F.lit, SEVERITIES)), rank.cast("int")).alias("worst"))


def contraindicated(patients: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, drug, condition, severity) for patients (id, drug, conditions array): equal names, else names that hold each other; underscores count as spaces."""
    plain = lambda x: F.replace(F.lower(x), F.lit("_"), F.lit(" "))
    rows = patients.select("id", plain(F.col("drug")).alias("drug"), F.explode("conditions").alias("condition")).withColumn("condition", plain(F.col("condition")))
    keyed = small(rules.select(plain(F.col("drug")).alias("d"), plain(F.col("condition")).alias("c"), "severity"))
    exact = rows.join(keyed, (rows.drug == keyed.d) & (rows.condition == keyed.c)).select("id", "drug", "condition", "severity")
    rest = rows.join(exact.select("id").distinct(), "id", "left_anti")
    held = lambda a, b: F.contains(a, b) | F.contains(b, a)
    loose = rest.join(keyed, held(rest.drug, keyed.d) & held(rest.condition, keyed.c)).select("id", "drug", "condition", "severity")
    return exact.union(loose)


def differential(cases: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, condition, score, symptoms) for cases (id, symptoms array): summed weights over the number of symptoms, 1 at most, from 0.01 on."""
    rows = cases.withColumn("n", F.greatest(F.size("symptoms"), F.lit(1))).select("id", "n", F.explode(F.transform("symptoms", lambda s: F.lower(clinical_key(s)))).alias("symptom"))
    found = rows.join(small(weights), "symptom").groupBy("id", "condition", "n").agg(F.sum("weight").alias("w"), F.sort_array(F.collect_set("symptom")).alias("symptoms"), F.min("ordinal").alias("ordinal"))
    out = found.withColumn("score", F.bround(F.least(F.round(F.col("w") / F.col("n"), 9), F.lit(1.0)), 3)).filter("score >= 0.01")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "ordinal"))
    return out.select("id", "condition", "score", "symptoms", rank.alias("rank"))


def protocol_steps(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, condition, icd10, step, description) of the first protocol whose name holds the asked condition or is held by it."""
    key = F.lower(clinical_key("condition"))
    rows = asked.select("id", key.alias("asked")).join(small(rules), F.contains("asked", "condition") | F.contains("condition", "asked"))
    best = rows.groupBy("id").agg(F.min_by(F.struct("condition", "icd10", "steps"), "ordinal").alias("p"))
    return best.select("id", "p.condition", "p.icd10", F.posexplode("p.steps").alias("step", "description")).withColumn("step", F.col("step") + 1)


def check_dosage(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, drug, known, low_mg, high_mg, dose_mg, capped, adjust) for (id, drug, weight_kg, age): weight times the rule's rates, never over its cap; under 2 and from 65 on a note to adjust."""
    joined = asked.withColumn("drug", F.lower(clinical_key("drug"))).join(small(rules), "drug", "left")
    high = F.col("weight_kg") * F.col("high")
    dose = F.bround(F.least(high, F.col("cap")), 2)
    return joined.select("id", "drug", F.col("cap").isNotNull().alias("known"), F.bround(F.col("weight_kg") * F.col("low"), 2).alias("low_mg"), F.bround(F.least(high, F.col("cap")), 2).alias("high_mg"), dose.alias("dose_mg"), F.coalesce(high > F.col("cap"), F.lit(False)).alias("capped"), F.when(F.col("age") < 2, "infant").when(F.col("age") >= 65, "elderly").alias("adjust"))


def mentioned(question: Column, known: list[str]) -> Column:
    """The known names that a question holds, in the list's order."""
    return F.filter(F.array(*map(F.lit, known)), lambda k: F.contains(F.lower(question), k))


def route(question: Column) -> Column:
    folded = F.lower(clinical_key(question))
    out = F.when(F.lit(False), "")
    for name, words in ROUTES:
        out = out.when(folded.rlike(words), name)
    return out.otherwise("general")


def answers(questions: DataFrame, spark: SparkSession) -> DataFrame:
    """(id, route, drugs, conditions, answer, confidence) for questions (id, text)."""
    asked = questions.select("id", route(F.col("text")).alias("route"), mentioned(F.col("text"), DRUGS).alias("drugs"), mentioned(F.col("text"), CONDITIONS).alias("conditions"))
    pairs = drug_interactions(asked.filter("route = 'interaction' and size(drugs) > 1"), interactions(spark)).groupBy("id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" + ", "a", "b"))), "; ").alias("pairs"))
    steps = protocol_steps(asked.filter("route = 'treatment'").select("id", F.explode("conditions").alias("condition")), protocols(spark)).groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", "description"))), lambda s: s["description"]), "; ").alias("steps"))
    limits = asked.filter("route = 'dosage'").select("id", F.element_at(F.col("drugs"), F.when(F.size("drugs") > 0, 1)).alias("drug")).join(small(dosages(spark)), "drug").select("id", F.format_string("%s: %.0f-%.0f mg/kg/day, at most %.0f mg", "drug", "low", "high", "cap").alias("limits"))
    joined = asked.join(pairs, "id", "left").join(steps, "id", "left").join(limits, "id", "left")
    text = F.coalesce("pairs", "steps", "limits", F.lit("no rule found"))
    sure = F.when((F.col("route") == "interaction") & (F.size("drugs") < 2), 0.5).when(F.col("route") == "interaction", F.when(F.col("pairs").isNotNull(), 0.85).otherwise(0.7)).when(F.col("route") == "dosage", 0.8).when(F.col("route") == "contraindication", 0.85).when(F.col("route") == "treatment", 0.8).otherwise(F.when(F.size("conditions") > 0, 0.7).otherwise(0.3))
    return joined.select("id", "route", "drugs", "conditions", text.alias("answer"), sure.alias("confidence"))
