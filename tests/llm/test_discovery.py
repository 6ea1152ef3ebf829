"""What the retrieving and bootstrapping parts find of planted cases: recall and precision."""

import random


def planted(seed):
    """Texts with fixed-rule seeds and unseen identifiers in telling contexts, and numbers in others."""
    rng = random.Random(seed)
    syl = ["ka", "lo", "mi", "ter", "san", "ved", "ru", "pel", "on", "ash"]
    word = lambda: "".join(rng.choice(syl) for _ in range(rng.randint(1, 4)))
    filler = lambda n: " ".join(word() for _ in range(n))
    mails = [f"{word()}.{word()}@{word()}.org" for _ in range(60)]
    phones = [f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}" for _ in range(60)]
    contexts = ["Kontakt: {} bitte", "reach me at {} any time", "customer account {} was opened", "member no. {} since", "carte de {} valable"]
    texts, want = [], set()
    for i in range(3000):
        c, kind = rng.choice(contexts), rng.random()
        if kind < 0.5:
            texts.append(f"{filler(9)} {c.format(rng.choice(mails + phones))} {filler(9)}")
        elif kind < 0.55:
            new = rng.choice([f"AB{rng.randint(10000, 99999)}", f"id-{rng.randint(100, 999)}-{word()}", f"{rng.randint(10**8, 10**9)}"])
            want.add((i, new))
            texts.append(f"{filler(9)} {c.format(new)} {filler(9)}")
        else:  # numbers that are no identifiers
            texts.append(f"{filler(9)} {rng.choice(['chapter', 'page', 'in', 'about', 'price of'])} {rng.randint(1, 10**6)} {filler(9)}")
    return texts, want


def test_pii_discovery(spark):
    from loomlint.llm import pii

    texts, want = planted(1)
    x = pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), ["doc_id"]).where("size(context) > 0").collect()
    got = {(r["doc_id"], c["value"]) for r in x for c in r["context"]}
    recall, precision = len(got & want) / len(want), len(got & want) / max(1, len(got))
    print(f"discovered {len(got)}: recall {recall:.2f}, precision {precision:.2f}")
    assert recall >= 0.7 and precision >= 0.95


def test_license_recall(spark):
    """Damaged templates of which enough is left, among other words, against exact containment."""
    from loomlint.llm import license

    rng = random.Random(5)
    texts = []
    for name, t in license.TEMPLATES.items():
        w = t.split()
        for _ in range(12):
            damaged = [x for x in w if rng.random() > 0.02] if len(w) > 20 else w
            at = rng.randrange(40)
            texts.append(" ".join([f"f{rng.randrange(999)}" for _ in range(at)] + damaged + [f"g{rng.randrange(999)}" for _ in range(60)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r["doc_id"], x["license"]) for r in license.scan(df).collect() for x in r["licenses"]}
    want = set()
    for i, t in enumerate(texts):
        have = set(license.template_shingles(t))
        for name, v in license.TEMPLATES.items():
            s = license.template_shingles(v)
            if (s and len(have & set(s)) / len(s) >= license.CONTAINED) or (not s and " all rights reserved " in f" {' '.join(license.template_words(t))} "):
                want.add((i, name))
    print(f"{len(want)} contained, {len(got & want)} found")
    assert got <= want and len(got) >= 0.99 * len(want)
