"""The chained pipeline against plain Python: shingle sets, benchmark windows, source totals and shard sizes are recomputed
from each stage's input without the operators' functions."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from citeloom.llm.catalogue import table
from citeloom.llm.shared import settled


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def kept_of_near_copies(docs):
    """The smallest id of each group that links of at least four fifths of five-word shingles connect."""
    sets = {}
    for d, text in docs.items():
        w = spaced(lowered(text))
        sets[d] = {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    holders, home = defaultdict(list), {d: d for d in docs}

    def root(d):
        while home[d] != d:
            d = home[d]
        return d

    for d, own in sets.items():
        for other in {o for s in own for o in holders[s]}:
            common = len(own & sets[other])
            if 100 * common >= 80 * (len(own) + len(sets[other]) - common):
                a, b = sorted((root(d), root(other)))
                home[b] = a
        for s in own:
            holders[s].append(d)
    return {root(d) for d in docs}


def clean_ids(docs, items):
    asked = defaultdict(set)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for text in items:
        w = word.findall(lowered(text))
        size = min(13, len(w))
        if size:
            asked[size] |= {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}
    clean = set()
    for d, text in docs.items():
        w, hit = word.findall(lowered(text)), set()
        for size, windows in asked.items():
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in windows:
                    hit.update(range(i, i + size))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.add(d)
    return clean


def targets(sizes, share=1.5, most=2.0, weights=(3.0, 1.0, 2.0)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left = {}, share * sum(sizes.values())
    open_ones = set(names)
    while open_ones:
        level = left / sum(weight[s] for s in open_ones)
        full = {s for s in open_ones if weight[s] * level > most * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_ones}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ones -= full
    return target


def best_sum(sizes, budget):
    """The largest sum of some of ``sizes`` that is not above ``budget``."""
    sums = 1
    for n in sizes:
        sums |= sums << n & (1 << budget + 1) - 1
    return sums.bit_length() - 1


def test_chained_stages(spark, folder):
    docs = table(spark, folder, "documents")
    items = [r.text for r in table(spark, folder, "benchmark").collect()]
    toxic = {r.doc_id for r in table(spark, folder, "labels").where("toxic = 1").collect()}
    for name, stage in corpus_pipeline.STAGES:
        after = settled(stage(spark, docs, folder))
        before = {r.doc_id: r for r in docs.select("doc_id", "text", "source").collect()} if name != "sharding" else {}
        texts = {d: r.text for d, r in before.items()}
        now = Counter(r.doc_id for r in after.select("doc_id").collect())
        if name == "quality":
            dropped = set(before) - set(now)
            assert max(now.values()) == 1 and set(now) <= set(before) and len(dropped) < len(before) / 2
            labelled = {r.doc_id for r in table(spark, folder, "labels").where("quality = 1 AND toxic = 0").collect()}
            assert len(dropped & labelled) <= 0.05 * len(labelled) and toxic
        elif name == "near_duplicates":
            assert now == Counter(kept_of_near_copies(texts))
        elif name == "decontamination":
            assert now == Counter(clean_ids(texts, items)) and len(now) < len(before)
        elif name == "mixing":
            size = {d: len(spaced(t)) for d, t in texts.items()}
            totals, took = Counter(), Counter()
            for d, r in before.items():
                totals[r.source] += size[d]
                took[r.source] += size[d] * now[d]
            aims = targets(totals)
            assert all(n <= 2 for n in now.values())
            for source, target in aims.items():
                sizes = [size[d] for d, r in before.items() if r.source == source]
                whole = round(target) // totals[source]
                assert took[source] == whole * totals[source] + best_sum(sizes, round(target) - whole * totals[source])
        else:
            rows = after.select("doc_id", "text", "shard", "slot", "size").collect()
            assert Counter(r.doc_id for r in docs.select("doc_id").collect()) == now
            places, load = defaultdict(list), Counter()
            for r in rows:
                assert r["size"] == len((r.text or "").encode()) + 8
                places[r.shard].append(r.slot)
                load[r.shard] += r["size"]
            assert all(sorted(p) == list(range(len(p))) for p in places.values())
            mean = sum(load.values()) / len(load)
            assert max(load.values()) - mean <= max(r["size"] for r in rows)
        docs = after
