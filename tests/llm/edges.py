"""Rows that every operator must get through."""

LONG = " ".join(f"word{i % 997} text{i % 31}" for i in range(40_000))
ONE_WORD = "abcdefghij" * 800


def documents(spark, empty=False):
    """doc_id, text, lang, source, n_chars, and columns whose names operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, label string, n_tokens int, digest string, g int, TEXT_KEY string, shard string, kept boolean"
    if empty:
        return spark.createDataFrame([], schema)
    extra = (1, "x", 2, "d", 3, "t", "s", True)
    plain = "The quick brown fox jumps over the lazy dog and runs away from the hunter in the forest."
    rows = [
        (1, plain, "en", "a", len(plain)),
        (2, plain, "en", "a", len(plain)),
        (2, plain, "en", "a", len(plain)),
        (3, None, "en", "a", None),
        (4, "", "de", None, 0),
        (None, plain + " Once more.", None, "b", None),
        (None, None, None, None, None),
        (5, LONG, "en", "hot", len(LONG)),
        (6, ONE_WORD, "fr", "hot", len(ONE_WORD)),
        (7, "\n\n  \n", "es", "hot", 5),
        (8, "Ein kurzer deutscher Satz über den Wald und die Jäger, die dort leben.", "de", "c", 70),
        (9, "Une phrase française sur la forêt et les chasseurs qui y vivent encore.", "fr", "c", 71),
        (10, "%%% ### 12345 $$$", "en", "c", 17),
        (11, "🎉 漢字 \x00 ﬁ ß " + "é" * 50, "es", "c", 60),
    ]
    return spark.createDataFrame([(*r, *extra) for r in rows], schema)
