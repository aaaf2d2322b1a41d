"""A table with every odd case that the operators define a result for."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, hi string, key string, id string, shard string, score string, n_words string, family string, size string, _y int"
CLASHES = (None,) * 10


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def passages():
    rng = random.Random(5)
    return {"items": [(i, prose(rng, 30) + ".") for i in range(6)] + [(6, None), (7, ""), (8, "short one here")], "shared": prose(rng, 70), "line": prose(rng, 8)}


@pytest.fixture(scope="session")
def rows(passages):
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(60, 200)) for _ in range(60)]
    base = prose(rng, 120).split()
    for k in range(10):  # near copies: neighbours are linked, the ends of the chain aren't
        texts.append(" ".join(base))
        base[10 + 11 * k % 105] = f"edited{k}"
    texts += [texts[0]] * 5 + [texts[1].upper()]  # exact copies, and one in capitals
    texts += [f"{prose(rng, 20)}\n{passages['line']}\n\t{passages['line'].upper()} \n{prose(rng, 15)}" for _ in range(5)]
    texts += [f"{prose(rng, 30)} {passages['shared']} {prose(rng, 30)}" for _ in range(4)]
    for i in (0, 1):  # leaked whole, and with an edited word and other punctuation
        item = passages["items"][i][1]
        texts.append(f"{prose(rng, 40)} {item} {prose(rng, 20)}")
        w = item.replace(".", "!").split()
        w[7] = "changed"
        texts.append(f"{prose(rng, 10)}\n{' '.join(w)} {prose(rng, 50)}")
    texts += ["", " \t\n ", "one", "two words", "four words are here", None, None, "x\x1cy z 　 é\x0b\x0cq", "a" * 50_000, "same " * 4000, prose(rng, 20_000)]
    texts += ["Licensed under the Apache License, Version 2.0.", f"{prose(rng, 60)}\nReleased under the MIT License.\nYou need a driving license to rent a car."]
    texts += ["noise### here$$$ and*** there%%% " * 20]
    out = [(i, t, "en", "s", None if t is None else len(t), *CLASHES) for i, t in enumerate(texts)]
    out += [out[3], out[3], (None, texts[2], None, None, None, *CLASHES), (None, None, None, None, None, *CLASHES)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    got = [(r[0], int("#" not in (r[1] or "") and bool(r[1])), 0) for r in rows if r[0] is not None]
    return spark.createDataFrame([*got, (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
