"""Tables with every odd case that the operators define."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double"
LONG = "lorem ipsum dolor sit amet " * 3000


def documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with clashing names."""
    same = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [
        (1, same, "en", "a", 5, 1, 0.5), (2, same + " fifteen", "en", "a", 5, 1, 0.5), (2, same + " fifteen", "en", "a", 5, 1, 0.5),
        (3, None, "en", "b", None, None, None), (4, "", None, None, 0, 1, 0.1), (5, "  \t\n ", "de", "b", 3, 1, 0.1),
        (6, LONG, "de", "b", len(LONG), 1, 0.1), (7, "Straße Ü 1.2.3.4 mail a.b@c.example.com now", "de", None, 5, 1, 0.1),
        (None, "no id at all here", None, "c", 5, 1, 0.1), (8, "123 !!! 456", "en", "c", 5, 1, 0.1), (9, "x", None, "c", 1, 1, 0.1),
    ]
    return spark.createDataFrame(rows, SCHEMA)
