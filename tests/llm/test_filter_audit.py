import re
from itertools import permutations

import numpy as np

from conftest import same_rows
from sluice.llm import filter_audit
from sluice.llm.queries import OP12_SQL, op12_filter_audit

DOCS = "doc_id long, text string, lang string, part string, mask long, n int"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """The contract, document by document and order by order."""
    texts = [(i, t or "", p or "") for i, t, p in docs]
    good, toxic = ({i for i, *ls in labels if i is not None and ls[k] == 1} for k in (0, 1))
    fails = []
    for i, t, _ in texts:
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        upper = len(re.findall("[A-Z]", t))
        copy = i is not None and any(j is not None and j < i and u == t for j, u, _ in texts)
        fails.append({"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * upper > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy})
    out = {}
    for part in {p for *_, p in texts}:
        own = [(i, f) for (i, _, p), f in zip(texts, fails, strict=True) if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                removed = [x for x in left if x[1][letter]]
                left = [x for x in left if not x[1][letter]]
                failing = sum(f[letter] for _, f in own)
                alone = sum(f[letter] and sum(f.values()) == 1 for _, f in own)
                out[part, "".join(order), step] = [len(left), len(removed), failing - len(removed), alone, sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)]
    shapley = {}
    for (part, order, step), v in out.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + v[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def rows_of(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}


def test_query_equals_its_sql(spark, sf_dir, oracle):
    got, want = op12_filter_audit(spark, sf_dir).toPandas(), oracle.execute(OP12_SQL).df()
    assert len(got) and same_rows(got, want)
    assert got.dtypes.map(str).to_dict() == {**{c: "int64" for c in got.columns}, "part": "object", "filter_order": "object", "step": "int32"}


def test_odd_rows_equal_a_plain_version(spark):
    rng = np.random.default_rng(2)
    long = " ".join(f"w{k}" for k in range(250))
    texts = [None, "", long, long + " A#", "a " * 300, "ABC def", "x y " * 210, "É" * 5, long.upper(), "tab\tand\x0bvt " * 120, "👩 " * 40]
    docs = [(int(i), texts[int(rng.integers(len(texts)))], [None, "en", "de"][int(rng.integers(3))]) for i in range(60)]
    docs += [(3, long, "en"), (3, long, "en"), (None, long, "de"), (None, long, None), (70, long, "")]  # repeated rows and rows without an id
    labels = [(int(i), int(rng.integers(2)), int(rng.integers(2))) for i in rng.integers(0, 60, 40)] + [(3, 1, None), (3, 0, 1), (None, 1, 1), (900, 1, 1)]
    frame = spark.createDataFrame([(*d, "p", 1, 2) for d in docs], DOCS)
    got = rows_of(filter_audit.audit(frame, spark.createDataFrame(labels, LABELS)))
    assert got == brute(docs, labels)


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert filter_audit.audit(none, spark.createDataFrame([], LABELS)).collect() == []
    one = spark.createDataFrame([(1, None, None, "p", 1, 2)], DOCS)
    got = rows_of(filter_audit.audit(one, spark.createDataFrame([], LABELS)))
    assert len(got) == 600 and got == brute([(1, None, None)], [])


def test_incidence_of_two_filters():
    of = filter_audit.incidence("AB")  # orders AB, BA
    assert of["removed"].tolist() == [[0, 0, 0, 0], [1, 0, 0, 1], [0, 1, 1, 0], [1, 0, 1, 0]]
    assert of["kept"].tolist() == [[1, 1, 1, 1], [0, 0, 1, 0], [1, 0, 0, 0], [0, 0, 0, 0]]
    assert of["redundant"].tolist() == [[0, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0], [0, 1, 0, 1]]
