"""Plain-Python statement of what the engine must return, for tiny inputs."""

from __future__ import annotations

import random

COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A", "N": "N"}


def rc(seq):
    return "".join(COMPLEMENT[b] for b in reversed(seq))


def clean_tiles(read, window, seed_len):
    for at in range(0, len(read) - seed_len + 1, seed_len):
        tile = read[at : at + seed_len]
        if "N" not in tile and window[at : at + seed_len] == tile:
            yield True


def alignments(sequences, reads, params):
    """Every window within k substitutions that holds a clean tile without N."""
    found = set()
    for read_id, read in reads:
        if read.count("N") > params.k:
            continue
        for is_rc, q in ((False, read), (True, rc(read))):
            for ref_id, text in sequences:
                for start in range(len(text) - len(q) + 1):
                    window = text[start : start + len(q)]
                    d = sum(a != b for a, b in zip(q, window))
                    if d <= params.k and any(clean_tiles(q, window, params.seed_len)):
                        found.add((read_id, ref_id, start, start + len(q), d, is_rc))
    return found


def unique(hits):
    result = set()
    for read_id in {h[0] for h in hits}:
        mine = [h for h in hits if h[0] == read_id]
        least = min(h[4] for h in mine)
        best = [h for h in mine if h[4] == least]
        if len(best) == 1:
            result.add(best[0])
    return result


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def extension(text, pattern, k):
    tried = [
        (edit_distance(pattern, text[:j]), j)
        for j in range(max(len(pattern) - k, 0), min(len(pattern) + k, len(text)) + 1)
    ]
    best = min(tried, default=(k + 1, 0))
    return best if best[0] <= k else None


def gapped(sequences, reads, params):
    """Best extension of every seed hit, then the least edits per place."""
    k, s, found = params.k, params.seed_len, {}
    for read_id, read in reads:
        if read.count("N") > k:
            continue
        for is_rc, q in ((False, read), (True, rc(read))):
            for at in range(0, len(q) - s + 1, s):
                seed = q[at : at + s]
                if "N" in seed:
                    continue
                for ref_id, text in sequences:
                    pos = text.find(seed)
                    while pos >= 0:
                        flank = params.flank_len
                        left = extension(text[max(pos - flank, 0) : pos][::-1], q[:at][::-1], k)
                        right = extension(text[pos + s : pos + s + flank], q[at + s :], k)
                        if left and right and left[0] + right[0] <= k:
                            key = (read_id, ref_id, pos - left[1], pos + s + right[1], is_rc)
                            found[key] = min(found.get(key, k), left[0] + right[0])
                        pos = text.find(seed, pos + 1)
    return {(a, b, c, d, n, e) for (a, b, c, d, e), n in found.items()}


def random_bases(rng, n, n_rate=0.0):
    return "".join("N" if rng.random() < n_rate else rng.choice("ACGT") for _ in range(n))


def mutate(rng, seq, substitutions):
    letters = list(seq)
    for at in rng.sample(range(len(seq)), substitutions):
        letters[at] = rng.choice([b for b in "ACGTN" if b != letters[at]])
    return "".join(letters)


def planted(seed, lengths=(36, 36), n_reads=60, ref_lengths=(400, 90, 36, 35, 20, 1)):
    """Sequences with N, one-letter and two-letter runs, and reads cut from them and changed."""
    rng = random.Random(seed)
    texts = [random_bases(rng, n, 0.01) for n in ref_lengths]
    texts[0] += "A" * 60 + "TA" * 30 + random_bases(rng, 50) + texts[0][100:180]
    sequences = list(enumerate(texts))
    reads = []
    for i in range(n_reads):
        length = rng.randint(*lengths)
        source = texts[0] if rng.random() < 0.8 else rng.choice([t for t in texts if len(t) >= length])
        start = rng.randrange(len(source) - length + 1)
        read = mutate(rng, source[start : start + length], rng.choice([0, 0, 1, 2, 3, 3, 4]))
        reads.append((i - 5, rc(read) if rng.random() < 0.5 else read))
    reads.append((1000, "A" * lengths[0]))
    reads.append((1001, "AT" * (lengths[0] // 2) + "A" * (lengths[0] % 2)))
    return sequences, reads
