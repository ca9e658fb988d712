"""Runs of letters beyond what is cached."""

from gridlore.llm import language


def test_the_whole_of_a_long_word_counts(spark):
    rows = [(i, w * 3, lang) for i, (w, lang) in enumerate([("the cat and the dog ", "en"), ("der hund und die katze ", "de")] * 30)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict("katze" * 13 + "thecatandthedog" * 40)[0] == "en"
    assert model.predict("thecat" * 11 + "derhundunddiekatze" * 40)[0] == "de"
    assert all(len(w) <= language.SHORT for w in model.seen)
