"""A language that is learned from one short text."""

from codesift.llm import language
from tests.llm.test_text_models import spoken


def test_language_of_one_short_text_takes_no_others(spark):
    learn = [(spoken(k, "en", 60), "en") for k in range(300)] + [("el perro corre muy rápido", "es")]
    model = language.fit(spark.createDataFrame(learn, "text string, lang string"))
    texts = [spoken(900 + k, "en", 8 + k) for k in range(40)]
    got = language.predicted(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()
    assert {r["lang_pred"] for r in got} == {"en"}
    own = language.predicted(spark.createDataFrame([("el perro corre muy rápido",)], "text string"), model).first()
    assert own["lang_pred"] == "es"
