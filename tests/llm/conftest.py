"""Small documents with what tables can hold: nulls, empty and long texts, ties, repeated rows, extra columns."""

ODD_TEXTS = [
    "The quick brown fox jumps over the lazy dog, and then it sleeps all day long.",
    "the quick brown fox jumps over the lazy dog, and then it sleeps all day long.",
    None,
    "",
    " \n\t ",
    "ÉTÉ été Été one two",
    "word " * 6000,
    "x",
    "0123456789" * 500,
    "日本語 テキスト 我们 \U0001f600 á",
    "The quick brown fox jumps over the lazy dog, and then it sleeps all day long.",
]


def docs_frame(spark, texts=None, ids=None):
    """documents with columns that clash with names used inside, a null doc_id and a repeated row."""
    texts = ODD_TEXTS if texts is None else texts
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "src0", len(t or ""), "k", 7, "r", "h", "s", 5, "x", "y", "b") for i, t in zip(ids, texts)]
    if texts is ODD_TEXTS:
        rows += [(None, "no id", *[None] * 12), rows[3], rows[0]]
    clashing = "kept string, n long, row string, hits string, sha string, id int, __hits string, __sha string, best string"
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {clashing}").repartition(3)
