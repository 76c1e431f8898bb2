"""Awkward texts shared by the tests."""

ODD = [
    None,
    "",
    " ",
    "\n",
    "a",
    " a b ",
    "a  b \n c\t d",
    "it's we'll  can't 12 345 x1y2",
    "naïve café — “quoted” 漢字かな 🙂🙂 é",
    "nb sp  em \x1c sep \x85 nel",
    "<|endoftext|> in the text <|endoftext|>",
    "x" * 500,
    " " * 300 + "end",
    "the cat sat on the mat. " * 40,
    "the cat sat on the mat. " * 40,
    "line one\nline two\n\nline one\r\n",
]


def frame(spark, texts, ids=None):
    """documents with columns whose names clash with those of results."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", f"s{k % 3}", 0 if t is None else len(t), k, "x", 1.0) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, kept string, score double")
