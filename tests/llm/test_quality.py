import numpy as np
import pytest

from leafmill.llm.quality import Reader, classify, jensen_shannon, structured_pages, text_quality

FW = {"en": {"the", "of", "and", "to", "in", "a", "was", "for", "that", "by", "on", "with", "as", "at", "from", "which", "not", "but", "it"}}
WORDS = [a + b for a in "court market ship stone river north table light paper horse".split() for b in ("", "s", "ed", "ing", "er", "ful", "less", "like", "man", "yard")]
PROSE = "The motion was filed by the court clerk in the spring of 2011, and the judge\nasked for the notice that was sent to the witness by the end of the week.\nIt was not the first time that the order from the court was late.\n"
LONG = "\n".join(f"The {WORDS[k % 97]} of the {WORDS[k % 89]} was sent to the {WORDS[k % 83]} and it was not in a {WORDS[k % 79]} with the {WORDS[k % 73]}." for k in range(4000))


def kind(text):
    s = Reader(FW).stats(text)
    return None if s[5] is None else classify(np.array([s[5]]), np.array([s[6]]))[0]


@pytest.mark.parametrize(
    "text,wanted",
    [
        (PROSE, "prose"),
        (PROSE + "1) the motion\n2) the order\n" + PROSE, "prose"),
        ("Checklist\n* tow receipt\n* skid mark and tyre tread\n* copy of the repair estimate\n* gearbox", "list"),
        ("tow receipt\nskid mark (May 2020)\nrepair estimate\ncopy of the gearbox\nbrake line\nfuel pump", "list"),
        ("no,item,units,rate\n1,lease,3,4.50\n2,title deed,4,9.10\n3,parcel map,7,1.00", "table"),
        ("Rate:      n/a      Ward:    2593\nUnits:     4,100    Batch:   991\nNet:    3   Gross:  4", "table"),
        ("Dosage ........ 6,959.60\nInfusion ..... 6,837.82\nTreatment ........ 3,942.99", "table"),
        ("05/07/2014 | rule | 5 | 6,975.35\n06/27/2014 | token | 2 | 2.89", "table"),
        ("SCAN SCAN SCAN603\n" * 6, "junk"),
        ("xgjragn ixzmh pms fes xe qh\nrrtadi c ajd izexqbsc iqvpi\nf wfdgqdxa tgrvpfmh isbenx zwphg bt sxdskxa d\nemwjixk fib pts siqsz rpvd qiks npvkik idcn ccicn gf kt kz\nqzjrzids ekegeagw npefstzs pilfiei qwjxz", "junk"),
        ("=}[;/}~-|+\\=^\\<}[_=,[*.~;#\n<=*=<,{~#/^+`\\`=<\\:;_#\\}|-*", "junk"),
        ("Hte rihtd rtapy tinoom omrf ugasut udlrevreo hbto eth toyicurtneolr inonticjun hnda eth edslae iebxhti xnide tuohhalg.\nIn nay neetv teh dlondral aeteedpr eth aliaprt ewscor autccon.", "junk"),
        ("This page is intentionally left blank", None),
        ("", None),
        (" \n\t", None),
        (None, None),
        (LONG, "prose"),
    ],
)
def test_kinds(text, wanted):
    assert kind(text) == wanted


def test_statistics(spark):
    df = spark.createDataFrame([(1, "The cat, a dog.\nno end", "clash"), (2, None, None), (3, " ", None)], "page_id bigint, text string, kind string")
    got = {r.page_id: r for r in text_quality(df, FW, ["page_id"]).collect()}
    assert got[1].word_count == 6 and abs(got[1].mean_word_length - 17 / 6) < 1e-9 and abs(got[1].symbol_ratio - 2 / 17) < 1e-9
    assert got[1].punctuated_lines == 0.5 and abs(got[1].common_words - 2 / 6) < 1e-9
    assert got[2].word_count == got[3].word_count == 0 and got[2].kind is None and got[3].symbol_ratio is None
    assert text_quality(df.limit(0), FW, ["page_id"]).count() == 0
    assert text_quality(df, {}, ["page_id"]).count() == 3


def test_repeats_count_once(spark):
    df = spark.createDataFrame([(1, "* a\n* b\n* c")] * 3, "page_id bigint, text string")
    assert [tuple(r) for r in structured_pages(df, FW).collect()] == [(1, "list")]


def test_divergence():
    p = np.array([[0.5, 0.5, 0.0]])
    assert jensen_shannon(p, p[0])[0] == 0 and abs(jensen_shannon(p, np.array([0.0, 0.0, 1.0]))[0] - 1) < 1e-12
