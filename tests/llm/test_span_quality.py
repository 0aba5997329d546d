"""Precision and recall of added spans, measured on texts whose spans are known.

Spans of each kind stand among decoys of the same look: hashes after "commit", product codes, account numbers with a wrong
check sum, order numbers, capitalised words of titles and places. Text is drawn anew for every seed.
"""

import random
from collections import Counter

from terrafold.llm import pii
from terrafold.llm._gazetteers import GIVEN, SURNAMES

from .cases import DOCS


def iban(r, good=True):
    country, n = r.choice([("DE", 18), ("ES", 20), ("GB", 18), ("FR", 23)])
    body = "".join(r.choice("0123456789") for _ in range(n))
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    check = 98 - number % 97
    return f"{country}{check if good else (check + 5) % 90 + 7:02d}{body}"


def key(r):
    return "".join(r.choice("abcdef0123456789") for _ in range(40))


def phone(r):
    return f"{r.randint(212, 989)}-{r.randint(223, 989)}-{r.randint(0, 9999):04d}".replace("911", "912").replace("-411", "-412")


def documents(seed, n=400):
    r = random.Random(seed)
    words = ["".join(r.choice("abdeilmnorstu") for _ in range(r.randint(2, 8))) for _ in range(300)]
    given, surnames = sorted(GIVEN), sorted(SURNAMES)
    person = lambda: f"{r.choice(given)} {r.choice(['', '', 'B. '])}{r.choice(surnames)}"
    makers = [
        ("secret", lambda: (r.choice(['api_key = "', "token: ", 'password="', "bearer "]), key(r))),
        ("iban", lambda: (r.choice(["account ", "IBAN: ", "Konto ", ""]), iban(r))),
        ("local", lambda: (r.choice(["phone ", "call ", "tel: ", "fax "]), phone(r))),
        ("name", lambda: (r.choice(["contact ", "Mr ", "Dr ", "signed by ", "", "said "]), person())),
        (None, lambda: (r.choice(["commit ", "sha256 ", "build/", "see https://x/"]), key(r))),
        (None, lambda: (r.choice(["part ", "serial ", "order "]), iban(r, False))),
        (None, lambda: (r.choice(["order ", "isbn ", "ref #"]), f"{r.randint(100, 199)}-{r.randint(100, 199)}.{r.randint(0, 9999):04d}")),
        (None, lambda: ("", r.choice(["Contact Form Letter", "Name Of Game", "Lake Street Station", "Grace Period Policy", "Martin Luther Church", "Hill Valley Road"]))),
    ]
    rows, truth = [], []
    for i in range(n):
        text = " ".join(r.choice(words) for _ in range(r.randint(5, 30)))
        for _ in range(r.randint(1, 3)):
            kind, make = r.choice(makers)
            cue, what = make()
            text += " " + cue
            if kind:
                truth.append((i, kind, len(text), len(text) + len(what)))
            text += what + ('"' if cue.endswith('"') else "") + " " + " ".join(r.choice(words) for _ in range(6)) + "."
        rows.append((i, text, "en", "s", 1))
    return rows, truth


def test_precision_and_recall_of_added_spans(spark):
    rows, truth = documents(1)
    got = set()
    for r in pii.span_digests(spark.createDataFrame(rows, DOCS)).collect():
        for s in filter(None, r["spans"].split(",")):
            k, a, b = s.split(":")
            if k in pii.ADDED:
                got.add((r["doc_id"], k, int(a), int(b)))
    right = got & set(truth)
    n_true, n_got, n_right = (Counter(x[1] for x in s) for s in (truth, got, right))
    table = {k: (round(n_right[k] / max(1, n_got[k]), 3), round(n_right[k] / n_true[k], 3)) for k in pii.ADDED}
    print("precision, recall:", table)
    assert all(p >= 0.95 for p, _ in table.values()) and all(x >= 0.7 for _, x in table.values()), table
