"""Intents of single clauses."""

from sitefit.operators.messages import intents

SAID = {"отключи все нормы": "norms", "почему тут нет деревьев": "question", "сними выделение": "deselect", "отмени последнее": "undo", "не надо удалять кусты": "keep",
        "удали эти кусты": "delete", "покажи нарушения": "violations", "выдели деревья": "select", "посади пореже": "spacing", "в два ряда": "rows", "построй заново": "regenerate",
        "что ты умеешь": "help", "привет": "greeting", "большое спасибо": "thanks", "нет": None, "газон у дома": None}


def test_first_intent_that_fits(spark):
    rows = intents(spark.createDataFrame([(k,) for k in SAID], "clause string"))
    assert {r.clause: r.intent for r in rows.collect()} == SAID
