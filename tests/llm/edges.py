"""Rows that every operator on documents must take: NULLs, blanks, long texts, repeats, and columns with clashing names."""
LONG = "the lazy brown fox jumps over a quick dog and then, again,\n" * 2000
TEXTS = [None, "", " \n\t ", "12 34 !!", "a", "héllo wörld ñ", LONG, "same text here twice over and over again", "same text here twice over and over again",
         "x" * 3000, "line one\nline one\nline two\n\n", "\x1c a b c", "MIT License", "漢字 😀 text"]
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, kept boolean, fp string, "
          "sequence_id string, x string, words string, starts string, decoded string")


def rows():
    ids = [None, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]
    made = [(i, t, "en" if k % 3 else None, None if k % 4 else "s", k) + (None,) * 2 + (True,) + ("z",) * 6 for k, (i, t) in enumerate(zip(ids, TEXTS))]
    return made + [made[6], (5, "another text under an id that is taken", "fr", "s", 1) + (None,) * 2 + (True,) + ("z",) * 6]


def documents(spark, parts=3):
    return spark.createDataFrame(rows(), SCHEMA).repartition(parts)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
