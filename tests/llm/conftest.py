"""Small tables with everything that may go wrong: nulls, empty and very long texts, ties, repeated rows."""

import random

import pytest

WORDS = "the and of river stone light walks under seven green hills while old songs drift over quiet water".split()

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, label string, shard string, node int"


def prose(seed, n):
    rng = random.Random(seed)
    made = lambda: rng.choice(WORDS) if rng.random() < 0.5 else "".join(rng.choices("abdeilnorst", k=rng.randint(3, 9)))
    return " ".join(made() for _ in range(n))


def edited(text, every):
    return " ".join(f"edit{i}" if i % every == every - 1 else w for i, w in enumerate(text.split(" ")))


ITEM = prose(900, 40)


def document_rows():
    long = prose(1, 90) + "\n" + prose(2, 120)
    texts = [(i, prose(100 + i, 60 + i)) for i in range(20)]
    texts += [(20, long), (21, long), (22, long), (23, edited(long, 70)), (24, edited(long, 60) + " tail")]
    texts += [(25, None), (26, ""), (27, " \t\n\r "), (28, "one"), (29, "ONE"), (30, "one"), (31, None)]
    texts += [(32, prose(3, 6000)), (33, "x" * 200_000), (34, "ha " * 300), (35, "a| b| c%%% " * 40)]
    texts += [(36, prose(4, 30) + " " + ITEM + " " + prose(5, 30)), (37, prose(6, 30) + " " + edited(ITEM, 9) + " end")]
    texts += [(38, "mail a.b@c.org now\nor +1 (555) 123-4567 and 4111 1111 1111 1111 at 10.0.0.1"), (39, "é ü ñ 漢字 q@r.st")]
    texts += [(60 + i, f"Report number {i} was filed by the office\n" + prose(300 + i, 55)) for i in range(7)]
    texts += [(5, prose(105, 65)), (5, prose(105, 65)), (None, "no id here at all"), (None, None), (None, long)]
    sources = ["a", "b", None, "B", "ab", "é"]
    return [
        (i, t, "en", sources[k % 6] if k % 3 else "a", None if t is None else len(t), "k", k, None, "s", 7)
        for k, (i, t) in enumerate(texts)
    ]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A folder of tables like the real ones, with extra columns whose names the operators use themselves."""
    root = str(tmp_path_factory.mktemp("odd"))
    rows = document_rows()
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{root}/documents.parquet")
    labels = [(i, int(i not in (34, 35)), int(i % 5 == 0)) for i in range(0, 40, 1)] + [(3, 1, 0), (None, 1, 1), (38, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    items = [(1, ITEM), (2, None), (3, ""), (None, "lost item"), (4, prose(901, 30)), (1, prose(902, 25))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("empty"))
    for name, schema in (
        ("documents", DOCUMENTS),
        ("labels", "doc_id long, quality int, toxic int"),
        ("benchmark", "item_id long, text string"),
    ):
        spark.createDataFrame([], schema).write.parquet(f"{root}/{name}.parquet")
    return root


@pytest.fixture(scope="session")
def documents():
    return [(r[0], r[1], r[3]) for r in document_rows()]


def run(query, spark, folder):
    """The rows of a query in an order of their own."""
    return sorted((tuple(r) for r in query(spark, folder).collect()), key=repr)
