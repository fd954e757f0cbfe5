"""Threats in the toxicity grammar: aimed before or behind, inflected, denied, reported; and weighed by labels."""

import pytest

from textloom.llm import toxicity


def score(text, threat=4.0):
    return toxicity.Scorer(toxicity.Model({"idiot": 7.0}, {}, (-5.0, 6.0, -1.4), threat)).score(text)[0]


@pytest.mark.parametrize("text", ["I will kill you", "you will be killed", "They were beating him", "ustedes van a ser golpeados, golpearé ustedes", "je vais vous frapper", "sie töten dich"])
def test_threats_at_someone_count_in_either_order(text):
    assert score(text) > 0.5 > score("")


@pytest.mark.parametrize("text", ["killing time on a train", "not kill you", 'he said "kill you"', "you. kill", "the skill of you", ""])
def test_others_do_not(text):
    assert score(text) < 0.5


def test_forms_of_a_verb():
    assert {"kill", "kills", "killed", "killing"} <= toxicity.forms("kill") and {"golpear", "golpea", "golpeó"} <= toxicity.forms("golpear")
    assert {"frapper", "frappe", "frappé"} <= toxicity.forms("frapper") and "skill" not in toxicity.forms("kill")


def learned(spark, toxic, clean):
    rows = [(k, t, 1) for k, t in enumerate(toxic)] + [(1000 + k, t, 0) for k, t in enumerate(clean)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    return toxicity.learn(docs, labels, held_out=None)


def test_the_weight_of_a_threat_comes_from_the_labels(spark):
    plain = [f"a quiet text number {k} about water and stone" for k in range(80)]
    threats = [f"number {k}: they will kill you soon" for k in range(40)]
    toxic, clean = learned(spark, threats, plain), learned(spark, plain[:40], threats + plain[40:])
    assert toxic.threat > 3 > clean.threat
    assert toxicity.Scorer(toxic).score("you will be killed")[0] > 0.7 > toxicity.Scorer(clean).score("you will be killed")[0]
