"""Plain Python models of the operators, for small inputs."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def counts(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_echo_words": sum(a == b for a, b in zip(w, w[1:])),
    }


def without_repeats(docs, window=13):
    first = {}
    for doc_id, text in docs:
        w = words(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, doc_id), doc_id)
    out = {}
    for doc_id, text in docs:
        w = words(text)
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < doc_id for j in range(i, i + window)}
        out[doc_id] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_classes(docs, threshold=0.8):
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(sets)
    links = defaultdict(set)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            union = len(sets[a] | sets[b])
            if union and len(sets[a] & sets[b]) / union >= threshold:
                links[a].add(b)
                links[b].add(a)
    root = {d: d for d in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            low = min([root[a], *(root[b] for b in links[a])])
            if low < root[a]:
                root[a], changed = low, True
    return {d: (root[d], len(links[d])) for d in ids}


def number_hash(value):
    """Spark's xxhash64 of a long."""
    h = xxhash.xxh64_intdigest(struct.pack("<q", value), seed=42)
    return h - 2**64 if h >= 2**63 else h


def shards(docs, n=8, salts=1024):
    """Shard and slot by running sums over the texts in digest order."""
    texts = defaultdict(list)
    for doc_id, text in docs:
        raw = (text or "").encode()
        texts[hashlib.md5(raw).hexdigest()].append((number_hash(doc_id) % salts, doc_id, len(raw) + 1))
    total, ahead, slots, out = sum(x[2] for own in texts.values() for x in own), 0, Counter(), {}
    for key in sorted(texts):
        own = sorted(texts[key])
        size = sum(x[2] for x in own)
        shard = min(n - 1, int((ahead + size / 2) * n / total))
        ahead += size
        for _, doc_id, _ in own:
            out[doc_id] = (shard, slots[shard])
            slots[shard] += 1
    return out


def base_failed(c):
    return c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]


def statistics(c):
    n = max(1, c["n_words"])
    return [float(c["n_words"]), *(c[k] / n for k in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_echo_words"))]


def learned(labelled, cuts, max_rules=8, max_conditions=3):
    """Rules ``[(statistic, above, threshold), ...]`` from ``(doc_id, counts, bad)`` and the cuts of each statistic."""
    rows = [(statistics(c), bad, number_hash(d) % 3 == 0) for d, c, bad in labelled if not base_failed(c)]
    holds = lambda s, rule: all((s[k] > t) == above for k, above, t in rule)
    rules = []
    while len(rules) < max_rules:
        rule = []
        while len(rule) < max_conditions:
            grow = [(s, bad) for s, bad, prune in rows if not prune and holds(s, rule)]
            n, hit = len(grow), sum(bad for _, bad in grow)
            if not hit or hit == n:
                break
            best = (0.0, 0.0, None)
            for k, values in enumerate(cuts):
                for t in values:
                    for above in (True, False):
                        own = [bad for s, bad in grow if (s[k] > t) == above]
                        if sum(own):
                            gain = sum(own) * (math.log2(sum(own) / len(own)) - math.log2(hit / n))
                            if gain > 0 and (gain, t if above else -t) > best[:2]:
                                best = (gain, t if above else -t, (k, above, t))
            if best[2] is None:
                break
            rule.append(best[2])
        if not rule:
            break
        scored = []
        for k in range(1, len(rule) + 1):
            own = [bad for s, bad, prune in rows if prune and holds(s, rule[:k])]
            scored.append(((2 * sum(own) - len(own)) / max(1, len(own)), -k, sum(own), len(own)))
        _, k, bad, n = max(scored)
        if bad < 3 or bad < 0.9 * n:
            break
        rules.append(rule[:-k])
        rows = [r for r in rows if not holds(r[0], rules[-1])]
    return rules


def good(counted, rules):
    s = statistics(counted)
    return not base_failed(counted) and not any(all((s[k] > t) == above for k, above, t in rule) for rule in rules)


def without_common_lines(docs, min_sites=10):
    """``(doc_id, text, source)`` without lines on many sites, but in their first place."""
    sites, first = defaultdict(set), {}
    for doc_id, text, source in docs:
        for i, line in enumerate(text.split("\n")):
            if WORD.search(line):
                sites[line].add(source)
                first[line] = min(first.get(line, (doc_id, i)), (doc_id, i))
    gone = lambda d, i, line: len(sites[line]) >= min_sites and first[line] != (d, i)
    return [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if not gone(d, i, x)), s) for d, t, s in docs]


def targets(sizes, weights=(5, 2, 1)):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(sizes), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target


def copies_in_mix(docs):
    """How often each of ``(doc_id, text, source)`` is taken."""
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += len(words(text))
    target, out = targets(sizes), {}
    for source in sizes:
        keyed = []
        for doc_id, text, own in docs:
            if own == source:
                n, marks = max(1, len(words(text))), len(re.findall(r"[#*$%&|<>]", text))
                draw = int(hashlib.md5(str(doc_id).encode()).hexdigest()[:13], 16)
                keyed.append((-math.log((draw + 0.5) / 2**52) / (n / (n + marks)), doc_id, len(words(text))))
        epochs = int(target[source] // sizes[source]) if sizes[source] else 0
        rest, ahead = target[source] - epochs * sizes[source], 0
        for _, doc_id, n in sorted(keyed):
            out[doc_id] = min(2, epochs + (ahead + n / 2 <= rest))
            ahead += n
    return out


def lowered(text):
    """A-Z only."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text):
    w = words(lowered(text))
    shingled = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingled]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=2):
    """A name of each fingerprint's component."""
    root = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a in root:
            low = min(root[b] for b in root if (a ^ b).bit_count() <= radius)
            if low < root[a]:
                root[a], changed = low, True
    return root


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def levels(hashes, fanout=3):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([digest(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(tree, i, fanout=3):
    """Position in its run and the run's others, level by level."""
    out = []
    for level in tree[:-1]:
        first = i // fanout * fanout
        out.append((i - first, [h for j, h in enumerate(level[first : first + fanout], first) if j != i]))
        i //= fanout
    return out


def manifest(rows):
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of ``(doc_id, source, lang, n_chars, text)``."""
    sources = defaultdict(list)
    for r in rows:
        sources[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(sources[s], key=lambda x: x[:3]) for s in order}
    trees = {s: levels([x[2] for x in own[s]]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (known, doc_id, h, r) in enumerate(own[s]):
            path = siblings(trees[s], i) + siblings(top, k)
            tampered = known and zlib.crc32(str(doc_id).encode()) % 2 == 0 and r[4] is not None
            now = leaf((*r[:4], r[4].replace("\n", ""))) if tampered else h
            for position, others in path:
                now = digest([*others[:position], now, *others[position:]])
            out.append((r[0], h, trees[s][-1][0], top[-1][0], digest(x for _, others in path for x in others), now, now == top[-1][0]))
    return out


def collocations(rows, least, limit):
    """``(lang, rank, phrase, a, l, r, n, score)`` of ``(lang, text)``."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    found = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= least}
    inside = Counter()
    for (lang, w), c in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], c)
    out = defaultdict(list)
    for (lang, w), a in found.items():
        if inside[lang, w] < a:
            cuts = ((f[lang, w[:k]], f[lang, w[k:]], k) for k in range(1, len(w)))
            score, _, left, right = min((1000 * a * n[lang] // (x * y), k, x, y) for x, y, k in cuts)
            out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return [
        (lang, rank, phrase.decode(), -a, left, right, n[lang], -score)
        for lang, own in out.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:limit], 1)
    ]
