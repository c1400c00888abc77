import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def made_up(n=120, seed=5):
    """Documents with null and empty texts, exact and near copies, and shared passages."""
    r = random.Random(seed)
    vocab = ["the", "of", "and", "Näh", "été", "x,", "don't", "12"] + [f"w{i}" for i in range(300)]
    para = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    shared = [para(60) for _ in range(3)]
    out = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "Two words")]
    for i in range(5, n):
        kind = r.random()
        if kind < 0.15 and i > 20:
            t = out[r.randrange(5, i)][1]
        elif kind < 0.3 and i > 20:
            w = out[r.randrange(5, i)][1].split(" ")
            w[r.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind < 0.5:
            t = f"{para(30)}\n{r.choice(shared)} {para(20)}"
        elif kind < 0.55:
            t = f"{(p := para(25))}\n{p} {p}"
        else:
            t = para(r.randrange(1, 150))
        out.append((i, t))
    out.append((n, "a" * 900 + " " + "ab " * 300))
    out.append((n + 1, "ab " * 250))
    return out


@pytest.fixture(scope="session")
def rows():
    return made_up()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(k, t, ["en", "fr"][k % 2], f"src{k % 3}", len(t or "")) for k, t in rows], DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
