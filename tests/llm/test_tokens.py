import random

from leafmill.llm.tokens import encode_texts, load_encoder


def test_ids_equal_the_library(spark):
    import public_tokenizers
    import tiktoken

    e = load_encoder()
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    rng = random.Random(3)
    letters = [chr(c) for c in (*range(0, 600), *range(0x2000, 0x2070), 0x3000, 0x4E2D, 0x1F600, 0x1C, 0x85, 0xFEFF)]
    texts = ["<|endoftext|> is text", " ", "\n\n  x", "a" * 5000, "don't  stop", "é" * 300, "\x00\x01"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    texts += ["".join(rng.choice("abcdef \n't19") for _ in range(rng.randint(1, 200))) for _ in range(400)]
    for t in texts:
        assert e.encode(t) == lib.encode_ordinary(t), repr(t)
        assert b"".join(e.tokens[i] for i in e.encode(t)) == t.encode()
    for t in texts[:60]:  # one piece as a whole, whatever the splitter makes of it
        data = t.encode()[:200]
        if data:
            assert e._piece(data) == e._merged(data, below=len(e.ranks) + 1)


def test_table(spark):
    df = spark.createDataFrame([(1, "Hello world", 9), (2, "", 9), (3, None, 9)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: list(r.ids) for r in encode_texts(df).collect()}
    assert got == {1: load_encoder().encode("Hello world"), 2: [], 3: []}
    assert encode_texts(df.limit(0)).count() == 0
