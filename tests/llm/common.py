"""Documents with every awkward case, for all operators."""

LONG = " ".join(f"w{k % 977} and" for k in range(40_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, `a.b` int, text_key int, __lower string, tokens string, new_shard string"


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), "clash", 7, 1, "clash", "clash", "clash")


AWKWARD = [row(1, None), row(2, ""), row(3, " \n "), row(4, LONG), row(None, "a text without an id"), row(6, "same text, twice over"), row(6, "same text, twice over"), row(7, "same text, twice over"), row(8, "null source", None, None), row(6, "same id, other text")]


def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
