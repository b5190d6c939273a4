"""The default dictionary of emoji names is whole."""

from quillspark.operators import emoji
from quillspark.plans.normalize import normalize
from quillspark.plans.queries import only


def test_list_is_whole():
    """Its length, its order and some names from all over it."""
    names = emoji.COMMON_NAMES
    assert len(names) == len(set(names)) == 871
    assert names[:4] == ("+1", "100", "1234", "8ball") and all(n == n.lower() and ":" not in n for n in names)
    assert {"pineapple", "dolphin", "whale", "horse", "ambulance", "heart_eyes_cat", "zzz"} <= set(names)


def test_valid_names_stay(spark):
    text = " ".join(f":{n}:" for n in (*emoji.COMMON_NAMES, "whale", "dolphin", "horse", "ambulance"))
    docs = spark.createDataFrame([(1, text + "\n"), (2, ":smilie: :Thumbs-Up: :qqqqqqqqqqqqqqqq:\n")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in normalize(docs, only(23)).collect()}
    assert got[1] == text + "\n"
    assert got[2] == ":smile: :thumbsup: :qqqqqqqqqqqqqqqq:\n"
