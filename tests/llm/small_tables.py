"""Small input tables with the odd cases."""

import random

#: Other columns with names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, spans string, set string, n_words int, row string, failures long"


def tables(spark, folder, rows, items=(), pages=()):
    """Writes small input tables: rows (doc_id, text), items (item_id, text), pages (page_id, url, html)."""
    full = [(i, t, "en", "s", len(t) if t else 0, 5, "x", "y", 3, "z", 1) for i, t in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, digest string").repartition(2).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def sample_texts(seed=3, n=60):
    """Texts with copies, near copies, shared passages, odd spacing, long and empty ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Éa", "ß", "the", "THE", "日本", "x" * 300, "don't", "12", "!!", "🙂"]
    word = lambda: rng.choice(vocabulary)
    passage = [word() for _ in range(60)]
    texts = []
    for i in range(n):
        w = [word() for _ in range(rng.choice([0, 1, 3, 19, 20, 40, 120, 200]))]
        if i % 5 == 0:
            w[len(w) // 2 : len(w) // 2] = passage
        if i % 7 == 3 and texts:
            w = rng.choice(texts).split()
            if w and rng.random() < 0.7:
                w[rng.randrange(len(w))] = word()
        texts.append("".join(x + rng.choice([" ", " ", "  ", "\n", "\t", "\r\n", "\x0b"]) for x in w))
    texts += [texts[10], texts[10], "a " * 3000, " ".join(passage * 3), " ", "", "one", "one two three", "ONE two three"]
    return texts


def sample_rows():
    rows = [(i * 3, t) for i, t in enumerate(sample_texts())]
    return [*rows, (None, rows[12][1]), (1000, None), (1001, "  lead and trail  "), (1002, "nbsp joined words")]
