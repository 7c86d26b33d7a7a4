import numpy as np
import pytest

from leafmill.llm.boost import Boosted
from leafmill.llm.repair import _candidates, _ops, found_noise, mended, page_number_of, repaired

SENTENCES = [
    "The committee reviewed the quarterly statement before the meeting.",
    "Neither the chairman nor the secretary mentioned the earlier statement.",
    "A separate committee described the remaining evidence after the meeting.",
    "When the secretary arrived, the left-hand cabinet was already empty.",
    "According to the chairman, the evidence required another meeting.",
]


@pytest.mark.parametrize(
    "line,wanted", [("Page 4 of 16", (4, True)), ("- 2l -", (21, True)), ("[l]", (1, True)), ("iii", (3, False)), ("p. 7", (7, True)), ("12", (12, False)), ("4/9", (4, True)), ("May 3", None), ("mix", None), ("KL-12", None)]
)
def test_page_numbers(line, wanted):
    assert page_number_of(line) == wanted


def test_ops():
    assert _ops("tbe", "the") == ("b>h",) and _ops("rnodern", "modern") == ("rn>m",) and _ops("fbe", "the") == ("f>t", "b>h") and _ops("abcdefg", "x") is None


def test_ops_with_the_longer_replacement_last():
    assert _ops("1isrn", "lism") == ("1>l", "rn>m") and _ops("rnaft", "matt") == ("rn>m", "f>t") and _ops("fbsrn", "thsm") is None


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_candidates_are_all_pairs_within_the_distance(spark):
    rng = np.random.default_rng(3)
    good = sorted({"".join(rng.choice(list("abcde"), rng.integers(2, 12))) for _ in range(60)} | {"record", "nothing", "liability", "most", "with"})
    doubt = {"rcc0rd", "n0thinq", "li@bilify", "rno5t", "vvlth"}
    for w in good:
        for edits in (1, 2, 3):
            x = list(w)
            for _ in range(edits):
                at = int(rng.integers(0, len(x) + 1))
                x[at : at + int(rng.integers(0, 2))] = rng.choice(list("abcdex"), int(rng.integers(0, 2)))
            doubt.add("".join(x))
    doubt = sorted(doubt - set(good) - {""})
    words = spark.createDataFrame([(w, 100, 0, 0) for w in good] + [(w, 1, 1, 0) for w in doubt], "word string, n bigint, flagged bigint, caps bigint")
    want = set()
    for w in doubt:
        for c in good:
            same = len(w) == len(c)
            most = max(1, min(3, len(w) - 1)) if same else 2 if len(w) <= 2 else 3
            if abs(len(w) - len(c)) <= 2 and distance(w, c) <= most:
                want.add((w, c))
    assert {(r.word, r.meant) for r in _candidates(words).collect()} == want
    assert {("rcc0rd", "record"), ("n0thinq", "nothing"), ("li@bilify", "liability"), ("rno5t", "most"), ("vvlth", "with")} <= want


def corpus(spark):
    """Forty files of four pages with a header, a footer, numbers, broken and misread words."""
    rows, page_id = [], 0
    wrong = {"statement": "staternent", "meeting": "mecting", "committee": "cornmittee", "evidence": "evidencc"}
    wrong |= {"chairman": "chairrnan", "separate": "scparate", "remaining": "rernaining", "secretary": "sccretary"}
    for f in range(40):
        for p in range(1, 5):
            page_id += 1
            body = [SENTENCES[(f + p + k) % 5] for k in range(5)]
            low = []
            if page_id % 8 == 0:
                word = list(wrong)[page_id // 8 % 8]
                hit = next(k for k, s in enumerate(body) if word in s and f"{word}s" not in s)
                body[hit] = body[hit].replace(word, wrong[word])
                low = [wrong[word]]
            if page_id % 5 == 0:
                body.append("The chairman kept the state-\nment in the left-\nhand cabinet.")
            text = f"Harbour Board | Vol. {1000 + f}\n\n" + "\n".join(body) + f"\n\nSubject to order\n- {p} -"
            rows.append((page_id, f, p, text, low, "clash"))
    rows += [(9001, None, 1, None, None, ""), (9002, 1, None, " \n", None, ""), rows[0]]
    return spark.createDataFrame(rows, "page_id bigint, file_id bigint, page_no int, text string, low_confidence_words array<string>, kind string"), wrong


def test_found(spark):
    df, wrong = corpus(spark)
    got = {tuple(r) for r in found_noise(df).collect()}
    kinds = {k: {(p, t) for p, kk, t in got if kk == k} for k in ("header", "page_number", "hyphen", "misread")}
    assert kinds["header"] == {(p, t) for p in range(1, 161) for t in (f"Harbour Board | Vol. {1000 + (p - 1) // 4}", "Subject to order")}
    assert kinds["page_number"] == {(p, f"- {(p - 1) % 4 + 1} -") for p in range(1, 161)}
    assert kinds["hyphen"] == {(p, t) for p in range(5, 161, 5) for t in ("statement", "left-hand")}
    assert kinds["misread"] == {(p, list(wrong)[p // 8 % 8]) for p in range(8, 161, 8)}


def test_words_of_any_length(spark):
    df, _ = corpus(spark)
    long = "donaudampfschifffahrtselektrizitaetengesellschaft"
    line = f"Then we met the secretary by the {long}."
    wrong = {9100: ("we", "wc"), 9101: (long, long.replace("tengesell", "tcngesell"))}
    rows = []
    for page_id in range(9100, 9160):
        right, read = wrong.get(page_id, ("", ""))
        rows.append((page_id, page_id, 1, f"{SENTENCES[0]}\n{line.replace(right, read) if right else line}\n{SENTENCES[1]}", [read] if read else [], ""))
    got = {(r.page_id, r.found_text) for r in found_noise(df.unionByName(spark.createDataFrame(rows, df.schema))).collect() if r.kind == "misread"}
    assert {g for g in got if g[0] >= 9100} == {(page_id, right) for page_id, (right, _) in wrong.items()}


def test_paragraphs(spark):
    df, wrong = corpus(spark)
    got = {r.page_id: r.text for r in repaired(df).collect()}
    assert len(got) == 162 and got[9001] is None
    assert "Harbour" not in got[40] and "- " not in got[40] and "The chairman kept the statement in the left-hand cabinet." in got[40]
    assert not any(w in t for t in got.values() if t for w in wrong.values())
    assert mended("a  b\n\n\nc", []) == "a b\n\nc"


def test_rows_do_not_depend_on_how_many_words_are_known(spark, monkeypatch):
    from leafmill.llm import repair

    df, _ = corpus(spark)
    whole = {tuple(r) for r in found_noise(df).collect()}
    monkeypatch.setattr(repair, "KNOWN_WORDS", 3)
    assert {tuple(r) for r in found_noise(df).collect()} == whole


def test_a_hundredfold_vocabulary_leaves_the_corrections(spark):
    from leafmill.llm.repair import corrections, first_pass, vocabulary_of

    df, wrong = corpus(spark)
    words = vocabulary_of(first_pass(df))
    small = {(r.word, r.meant) for r in corrections(words).collect()}
    large = words.selectExpr("word", "n * 100 as n", "flagged * 100 as flagged", "caps * 100 as caps")
    assert small == {(w, m) for m, w in wrong.items()} == {(r.word, r.meant) for r in corrections(large).collect()}


def test_junk_is_told_by_its_letters(spark):
    df, wrong = corpus(spark)
    junk = "qzvx jkwq xxqv zzkj wqxp vvkz jqqx kzzv pqxw mecting xkqj vzqk"
    rows = [(9300, 9300, 1, junk, ["mecting"], ""), (9301, 9301, 1, "Xkqj 4,100.50\nThe mecting 5.00\nOf evidence 7.00\nchairman 9.00 8.00", ["mecting"], "")]
    got = {(r.page_id, r.found_text) for r in found_noise(df.unionByName(spark.createDataFrame(rows, df.schema))).collect() if r.kind == "misread" and r.page_id >= 9300}
    assert got == {(9301, "meeting")}


def test_a_footer_that_reads_like_prose(spark):
    df, _ = corpus(spark)
    line = "This transcript is confidential and may not be copied without the leave of the board."
    rows = [(9400 + p, 9400, p, "\n".join([SENTENCES[(p + k) % 5] for k in range(7)] + [line]), [], "") for p in range(1, 6)]
    got = {(r.page_id, r.found_text) for r in found_noise(df.unionByName(spark.createDataFrame(rows, df.schema))).collect() if r.kind == "header" and r.page_id >= 9400}
    assert got == {(9400 + p, line) for p in range(1, 6)}


def test_empty(spark):
    df, _ = corpus(spark)
    assert found_noise(df.limit(0)).count() == 0


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = Boosted(rounds=40).fit(x[:3000], y[:3000])
    assert ((m.probability(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert Boosted().fit(np.zeros((0, 3)), np.zeros(0)).probability(np.zeros((2, 3))).shape == (2,)


def test_the_first_pass_strips_a_token_once_however_often_it_stands(monkeypatch):
    import pyarrow as pa

    from leafmill.llm import repair

    calls = []
    bare = repair._bare
    monkeypatch.setattr(repair, "_bare", lambda token: calls.append(token) or bare(token))
    text = "Some words, (some) words- \nby hand; some words\n\nand so on"
    rows = {"page_id": [1, 2, 3], "file_id": [1, 1, 1], "page_no": [1, 2, 3], "text": [text, text, " "], "low": [["hand;"], None, None]}
    out = [r for b in repair._first_pass(iter(pa.RecordBatch.from_pydict(rows).slice(k, 1) for k in range(3))) for r in b.to_pylist() if r["what"] == "w"]
    assert {r["word"]: (r["n"], r["flagged"], r["caps"]) for r in out} == {
        "some": (6, 0, 2), "words": (4, 0, 0), "hand": (2, 1, 0), "and": (2, 0, 0), "so": (2, 0, 0), "on": (2, 0, 0),
    }
    assert len(calls) == len(set(calls)) + 1  # the flagged word is looked up besides


def test_the_second_pass_judges_a_word_once_whatever_stands_around_it(monkeypatch):
    import pyarrow as pa

    from leafmill.llm import repair

    judged = []
    judge = repair._judge
    monkeypatch.setattr(repair, "_judge", lambda low, *x: judged.append(low) or judge(low, *x))
    letters = repair.Letters(repair.np.ones(28**3))
    text = 'The modem, (modem) "modem" Modem. a_b 12 1a 12a4 x²y the\nend modern'
    pages = pa.RecordBatch.from_pydict({"page_id": [1, 2], "text": [text, text]})
    (out,) = repair._second_pass(frozenset({"the", "end"}), letters)(iter([pages]))
    assert "modem" in judged and len(judged) == len(set(judged))
    words = {r["token"] for r in out.to_pylist() if r["page_id"] == 1 and r["kind"] == "misread"}
    assert {"modem", "Modem", "modern", "1a", "12a4"} <= words and not words & {"The", "the", "end", "12", "a_b"}


def test_a_line_loses_its_own_page_number_only():
    import pyarrow as pa

    from leafmill.llm import repair

    lines = ["Annual Report  l2", "Annual Report 13", "Annual Report 12", "Report page 12", "Report12", "None"]
    rows = {"page_id": range(7), "file_id": [1] * 7, "page_no": [12] * 6 + [None], "text": [*lines, "None"], "low": [[]] * 7}
    batch = pa.RecordBatch.from_pydict({k: pa.array(list(v), pa.list_(pa.string()) if k == "low" else None) for k, v in rows.items()})
    got = [r["key"] for b in repair._first_pass(iter([batch])) for r in b.to_pylist() if r["what"] == "e"]
    assert got == ["Annual Report", "Annual Report 13", "Annual Report", "Report", "Report12", "None", "None"]
