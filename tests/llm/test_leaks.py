import random
import re

from leafmill.llm.leaks import Index, covered, leaked, places, shingles, words_as_written, words_of


def made(rng, n):
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_planted_passages(spark):
    rng = random.Random(5)
    items = [(k, "s", made(rng, rng.randint(40, 120)) + " What should happen next?") for k in range(60)]
    docs, want = [], set()
    for d in range(300):
        body = made(rng, rng.randint(100, 900)).split()
        if d % 3 == 0:
            k = rng.randrange(60)
            words = items[k][2].split()
            part = words[: int(len(words) * 0.7)] if d % 2 else words
            part = [("c" + w[1:] if rng.random() < 0.03 else w) for w in part]  # misread here and there
            at = rng.randrange(len(body))
            body[at:at] = ["WORD-\n" + part[0].upper() + ",", *part[1:]]
            want.add((d, k))
        elif d % 3 == 1:
            body += "What should happen next?".split() + items[rng.randrange(60)][2].split()[:12]
        docs.append((d, " ".join(body), 0))
    docs += [(1000, None, 0), (1001, "", 0), (0, docs[0][1], 0)]
    got = leaked(spark.createDataFrame(docs, "doc_id bigint, text string, item_id int"), spark.createDataFrame(items + [(900, "s", None), (901, "s", "two words")], "item_id bigint, suite string, text string"))
    assert {tuple(r) for r in got.collect()} == want


def test_search_equals_brute_force():
    rng = random.Random(9)
    items = [(k, words_of(made(rng, 50))) for k in range(20)]
    ix = Index(items)
    for _ in range(100):
        item = items[rng.randrange(20)][1]
        a = rng.randrange(30)
        doc = words_of(made(rng, 60)) + item[a : a + rng.randint(5, 50)] + words_of(made(rng, 60))
        brute = [i for i, w in items if covered(len(w), places(w, 3), shingles(doc, 3), 3) >= 0.5 and covered(len(w), places(w, 4), shingles(doc, 4), 4) >= 0.4]
        assert ix.found(doc) == brute


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert leaked(docs, items).count() == 0 and leaked(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), items.limit(0)).count() == 0


def test_half_of_an_item_with_changed_words():
    rng = random.Random(3)
    items = [(k, words_of(made(rng, 80))) for k in range(10)]
    ix = Index(items)
    for k, item in items:
        part = item[: len(item) // 2 + 4]
        for at in (5, 12, 20, 28, 36):  # a changed word takes its neighbours out of the shingles
            part[at] = "changed"
        doc = words_of(made(rng, 60)) + part + words_of(made(rng, 60))
        assert covered(len(item), places(item, 4), shingles(doc, 4), 4) < 0.5
        assert ix.found(doc) == [k]
        less = item[: len(item) // 3]
        assert ix.found(words_of(made(rng, 60)) + less + words_of(made(rng, 60))) == []


def test_words_are_the_runs_of_letters_and_digits():
    marker = re.compile(r"(?m)^\s*-{3,}.*-{3,}\s*$|^\s*>+ ?")
    broken = re.compile(r"(?<=[^\W\d_])[-‐¬\xad] ?\n(?:> )?\s*(?=[^\W\d_])")
    fold = str.maketrans({"0": "o", "1": "l", "5": "s", "@": "a", "6": "b", "|": "l", "$": "s", "ﬁ": "fi", "ﬂ": "fl"})
    rng = random.Random(1)
    odd = "abI0156@|$ﬁﬂéßİΣς٣½²_-‐¬\xad’“ \t\n\r\x0b\x1c\x1f\x85\xa0　\x00\x7f>.—漢́ªZ" + "ab \n->" * 4
    for _ in range(20_000):
        text = "".join(rng.choice(odd) for _ in range(rng.randint(1, 25)))
        plain = broken.sub("", marker.sub("", text)).lower()
        assert words_of(text) == re.findall(r"[^\W_]+", plain.translate(fold))
        assert words_as_written(text) == re.findall(r"[^\W_]+", plain)
