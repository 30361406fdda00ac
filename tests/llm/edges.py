"""Tables with everything that operators must bear: nulls in every column, empty and long texts, ties, repeated rows, clashing names."""

LONG = " ".join(f"word{i}" for i in range(4000)) + "\n" + "\n".join(f"line {i % 7}" for i in range(300))
COMMON = "This line is everywhere."
TEXTS = [
    None, "", " ", "\n\n", "one", "one two", "ONE two\nthree", LONG, LONG, f"{COMMON}\nown {{}}", "Ünïcödé ßtraße 漢字\r\n\x0btab\there", "a" * 5000, "\x00nul", "x  y\n\n z ",
]


def documents(spark, repeats=12):
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"src{i % 3}", None, "n", 1, b"k") for i, t in enumerate(TEXTS)]
    rows += [(100 + i, f"  {COMMON.upper()}  \nbody number {i} has words of its own\n{COMMON}", "en", "src0", 7, "n", 1, b"k") for i in range(repeats)]
    rows += [rows[6], rows[6], (6, "another text of document six", None, None, None, None, None, None), (None, "no id", "en", None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_lines string, size int, key binary")


def empty(spark):
    return documents(spark).where("false")
