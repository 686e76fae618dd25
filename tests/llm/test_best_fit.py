"""Best-two-fit packing against brute force, and its ids against the tokenizer."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from switchyard.llm import best_fit
from switchyard.llm import queries as Q


def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(best_fit.tokenizer_file())


def test_ids_equal_the_tokenizers():
    own, tool, rnd = best_fit.WordEncoder(best_fit.tokenizer_file()), tokenizer(), random.Random(1)
    letters = [chr(c) for c in range(0xC0, 0x250)]
    texts = ["", "  ", "don't 'tis 'S x'll", "İstanbul ΑΣ Σ", "é a ́b", "x<|endoftext|>y <|startoftext|>",
             "a\x1cb c\r\nd", "ﬁ Å 한글", "<|ENDOFTEXT|>, x", "H̱ḧ h̸, ≠", "é, İ. ß; œuf?", "a1b2 http://x.y/z?q=1", "<a> ^ ~ | ` \\ _x_ {b}", "a.b,c (f) g;:h", "A" * 3000,
             "".join(letters), *letters, *[f"a{c}.B" for c in letters]]
    pool = "aAzéÉßİıΣσs' '\"<|>.,!?-_ \t\n\r\x0b\x1c ́I̊019½\U0001f600한"
    texts += ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12))) for _ in range(4000)]
    for text, ids in zip(texts, own.encode_texts(pa.array(texts)), strict=True):
        assert ids.tolist() == tool.encode(text, add_special_tokens=False).ids, text


def one_by_one(counts, capacity):
    """Best-two-fit, one bin and one document at a time."""
    left, bins = sorted([n for n, k in counts.items() for _ in range(k)], reverse=True), []
    while left:
        content, gap, rest = [], capacity, []
        for d in left:
            if d <= gap:
                content.append(d)
                gap -= d
            else:
                rest.append(d)
        smallest, best, pair = content[-1], (content[-1], 0), None
        if gap and len(content) > 1:
            for i in range(len(rest)):
                for j in range(i + 1, len(rest)):
                    total = rest[i] + rest[j]
                    if smallest < total <= gap + smallest and (total, rest[i]) > best:
                        best, pair = (total, rest[i]), (i, j)
        if pair:
            content = [*content[:-1], *[rest[i] for i in pair]]
            rest = sorted([d for k, d in enumerate(rest) if k not in pair] + [smallest], reverse=True)
        bins.append(sorted(content, reverse=True))
        left = rest
    return bins


def test_plan_equals_one_bin_at_a_time():
    rnd = random.Random(4)
    for _ in range(200):
        capacity = rnd.choice([10, 20, 50])
        counts = {n: rnd.randint(1, 9) for n in rnd.sample(range(1, capacity + 1), rnd.randint(1, 10))}
        found = [[n for n, k in content for _ in range(k)] for repeats, content in best_fit.plan(counts, capacity) for _ in range(repeats)]
        assert found == one_by_one(counts, capacity)


def test_plan_is_small_and_tight_for_any_number_of_documents():
    rnd = random.Random(9)
    counts = {n: rnd.randint(0, 10**9) for n in range(1, 2049)}
    found = best_fit.plan(counts, 2048)
    assert len(found) < 20_000
    total = sum(n * k for n, k in counts.items())
    assert sum(r * n * k for r, content in found for n, k in content) == total
    # Documents of over half a sequence each open one; the rest must fit around them.
    least = max(-(-total // 2048), sum(k for n, k in counts.items() if n > 1024))
    assert sum(r for r, _ in found) <= 1.01 * least


def check_pieces(pieces, texts, capacity, end_id=0):
    """Every id once, gapless sequences; ``texts``: (doc_id, text) rows."""
    tool = tokenizer()
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id].append((p.piece, p.start, p.length, p.ids_crc32))
    for content in sequences.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    want = defaultdict(list)
    for doc, text in texts:
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, end_id]
        for k, lo in enumerate(range(0, len(ids), capacity)):
            piece = ids[lo:lo + capacity]
            want[doc].append((k, lo, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    assert {d: sorted(p) for d, p in by_doc.items()} == {d: sorted(p) for d, p in want.items()}
    return len(sequences)


def test_pack_keeps_every_id(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta.", "don't", "42"]) for _ in range(rnd.randint(0, 60)))) for i in range(400)]
    rows += [(None, "no id"), (None, "no id"), (7, "a second seven"), (500, None), (501, ""), (502, "word " * 500), (503, "same"), (504, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("x")).withColumn("ids", F.lit(1)).repartition(5)
    found = best_fit.pack(df, capacity=64).collect()
    n = check_pieces(found, rows, 64)
    assert n <= -(-sum(p.length for p in found) // 64) + 1
    tool = tokenizer()
    long = sorted((p.piece, np.frombuffer(p.ids, "<u2").tolist()) for p in found if p.doc_id == 502)
    assert sum([ids for _, ids in long], []) == [*tool.encode("word " * 500, add_special_tokens=False).ids, 0]


def test_query_on_its_table_and_on_an_empty_one(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = Q.op13_best_fit(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check_pieces(found.collect(), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 2048)
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert Q.op13_best_fit(spark, str(tmp_path)).collect() == []
