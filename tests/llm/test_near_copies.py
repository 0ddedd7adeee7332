"""Near copies of the pipeline's stage against all pairs."""

import random

from llm_cases import AWKWARD, docs

import corpus_pipeline
from meterline.llm import nearcopies
from meterline.llm.simhash import fingerprint_of, near_duplicates


def jaccard(a, b, words=5):
    def sets(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))}
    a, b = sets(a), sets(b)
    return len(a & b) / len(a | b)


def family(seed, n, words=120):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n - 1):
        own, at = list(base), rng.randrange(words)
        own[at:at + 3] = [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 6))]
        out.append(" ".join(own))
    return out


def test_stage_finds_near_copies_beyond_three_bits(spark):
    texts = [t for s in range(30) for t in family(s, 4)]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    assert sum((fingerprint_of(texts[i]) ^ fingerprint_of(texts[j])).bit_count() > 3 for i, j in pairs) > len(pairs) / 2
    least = list(range(len(texts)))
    for _ in range(4):
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
    table = docs(spark, list(enumerate(texts)))
    got = corpus_pipeline.drop_near_copies(spark, table, "").collect()
    assert sorted(r.doc_id for r in got) == sorted(set(least)) and got[0].__fields__ == table.columns


def test_stage_links_by_fingerprints(spark):
    """Fingerprints at three bits or fewer link, also where shingles are unlike, and chain with links by similarity."""
    def mostly(phrase, n, tail):
        return " ".join([phrase] * n + [f"{tail}{i}" for i in range(25)])

    texts = [mostly(f"p{f} q{f} r{f}", 60 + 60 * k, f"t{f}x{k}_") for f in range(6) for k in range(4)]
    texts += [texts[0] + " and some more words", *[t for s in range(5) for t in family(s, 3)]]
    near = {}
    for i in range(len(texts)):
        for j in range(i):
            bits, alike = (fingerprint_of(texts[i]) ^ fingerprint_of(texts[j])).bit_count() <= 3, jaccard(texts[i], texts[j]) >= 0.8
            if bits or alike:
                near[i, j] = bits, alike
    assert sum(b and not a for b, a in near.values()) > 10 and any(a and not b for b, a in near.values())
    least = list(range(len(texts)))
    for _ in range(len(texts)):
        for i, j in near:
            least[i] = least[j] = min(least[i], least[j])
    got = corpus_pipeline.drop_near_copies(spark, docs(spark, list(enumerate(texts))), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(least))


def test_stage_drops_what_op3_drops(spark):
    rows = [*AWKWARD, (20, "a b c " * 300 + "one end"), (21, "a b c " * 300 + "another end of it"), (22, "a b c " * 200)]
    table = docs(spark, rows)
    alone = {r.doc_id for r in near_duplicates(table).where("kept").collect()}
    stage = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table, "").collect()}
    assert stage <= alone and {20, 21, 22} - stage == {21, 22}


def test_chains_and_unlike_texts_of_a_bucket(spark):
    """Links that the bucket's smallest row has no part in are found, pairs below the threshold are none."""
    base = [f"w{i}" for i in range(200)]
    chain = [" ".join([f"c{k}" for k in range(8 * i)] + base[8 * i:]) for i in range(12)]
    assert jaccard(chain[0], chain[1]) >= 0.8 > jaccard(chain[0], chain[5])
    table = docs(spark, [(i, t) for i, t in enumerate(chain)] + [(100, " ".join(base[:80] + [f"y{i}" for i in range(120)]))])
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(table).collect()}
    assert {got[i] for i in range(12)} == {0} and got[100] == 100


def test_awkward_rows(spark):
    got = nearcopies.near_copies(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    zero = [r for r in got if not (r.text or "").split()]
    assert sum(r.kept for r in zero) == 1
    for component in {r.component_id for r in got}:
        assert sum(r.kept for r in got if r.component_id == component) == 1
    assert nearcopies.near_copies(docs(spark, AWKWARD).limit(0)).count() == 0
