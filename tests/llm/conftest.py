import random

import pandas as pd
import pytest


def texts() -> list[str | None]:
    """Nulls, blanks, odd characters, one very long word, copies, near copies, shared lines and passages, junk."""
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghi") for _ in range(r.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", "", "", ".", ","]) for _ in range(n))
    passage, line, base = prose(60), "A line that many documents share, of sixty letters or more.", prose(200)
    out: list[str | None] = [None, "", " ", "\n\n\t", "x", "Licensed under the Apache License, Version 2.0.\nMIT License mit license", "y" * 5000, "\x1c  é Ünïcode\x85z ' 's don't <|endoftext|>"]
    out += [prose(r.randint(5, 120)) for _ in range(12)] + [prose(2500)]
    out += [f"{prose(30)}\n{line}\n{prose(20)}" for _ in range(6)] + [f"{prose(10)} {passage} {prose(10)}" for _ in range(4)]
    out += [base, base, base, base.upper(), base.replace(base.split()[50], "CHANGED", 1), base + " tail words here"]
    out += ["Home | News | About | Login | Help | More | Shop | Cart | Mail | Sites | Jobs | End", "buy!! now!! " * 12, "ha " * 40, "a### b*** c%%% d$$$ e&&& f### g*** h%%% i$$$ j&&&"]
    return out


@pytest.fixture(scope="session")
def edge(tmp_path_factory):
    """A folder with documents and benchmark that hold the hard cases; ids don't follow the order of the rows."""
    folder = tmp_path_factory.mktemp("edge")
    t = texts()
    ids = [(7 * i + 3) % len(t) for i in range(len(t))] if len(t) % 7 else list(range(len(t)))[::-1]
    pd.DataFrame({"doc_id": ids, "text": t, "lang": "en", "source": "s", "n_chars": [len(x or "") for x in t], "hash": 1, "words": "clash"}).to_parquet(folder / "documents.parquet")
    passages = [x for x in t if x and len(x.split()) > 70]
    items = [" ".join(passages[0].split()[5:40]), passages[1].split()[3], "  ", None, " ".join(passages[2].split()[:13]).upper(), " ".join(passages[2].split()[:13])]
    pd.DataFrame({"item_id": [5, 6, 7, 8, 30, 4], "text": items, "win": 0}).to_parquet(folder / "benchmark.parquet")
    vectors = [[r.gauss(0, 0.2) for _ in range(4)] for r in [random.Random(3)] for _ in range(150)]
    vectors += [None, [], [0.5, None, 0.1, 0.1], [float("nan")] * 4, [float("inf"), 0, 0, 0], [0.0] * 4] + [vectors[0]] * 20
    labels = [None if k == 9 else k % 3 for k in range(len(vectors))]
    frame = pd.DataFrame({"vec_id": pd.array([None if k == 77 else k for k in range(len(vectors))], dtype="Int64"), "label": pd.array(labels, dtype="Int32"), "id": 1, "cell": 2, "v": "x"})
    frame["embedding"] = [None if v is None else [None if x is None else float(x) for x in v] for v in vectors]
    frame.to_parquet(folder / "embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def empty(spark, edge, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{edge}/{name}.parquet").where("false").coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    spark.read.parquet(f"{edge}/embeddings.parquet").where("false").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return folder
