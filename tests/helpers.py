"""Plain Python versions of the rules, written row by row from their description."""

import difflib
import string

import numpy as np


ASCII_WORD = frozenset(string.ascii_lowercase + string.digits)


def key(name):
    """What of a lower-case name is a plain letter, a digit or a sign of sex."""
    return "".join(filter((ASCII_WORD | {"\u2640", "\u2642"}).__contains__, name.lower()))


def canonical(name):
    """The words of a lower-case name, tied by underscores."""
    return "_".join(name.lower().split())


def unit(vectors):
    vectors = np.asarray(vectors, dtype=np.float64)
    return vectors / np.linalg.norm(vectors, axis=-1, keepdims=True)


def brute_topk(queries, bank, k):
    """{query id: [(row id, species, similarity)]}, ties by row id."""
    out = {}
    for q_id, q in queries:
        sims = [(round(float(np.dot(q, v)), 12), r, s) for r, s, v in bank]
        sims.sort(key=lambda x: (-x[0], x[1]))
        out[q_id] = [(r, s, x) for x, r, s in sims[:k]]
    return out


def brute_vote(neighbors, near_exact):
    votes = {}
    for rank, (_, species, sim) in enumerate(neighbors):
        n, best, first = votes.get(species, (0, -9.0, rank))
        votes[species] = (n + 1, max(best, sim), first)
    winner = max(votes, key=lambda s: (votes[s][0], votes[s][1], -votes[s][2]))
    score = votes[winner][1]
    _, top, top_sim = neighbors[0]
    if near_exact is not None and top != winner and top_sim >= near_exact:
        return top, top_sim
    return winner, score


def brute_learn(bank, requests, dim, dup_sim=0.995):
    """One request after the other. bank: [(species, vec)], requests: [(seq, name, vec, allow_new)]."""
    rows = [(s, np.asarray(v, dtype=np.float64)) for s, v in bank]
    start = sorted({s for s, _ in rows})
    out = []
    for seq, name, vec, allow in sorted(requests, key=lambda r: r[0]):
        name = name.strip()
        ok = bool(name) and len(name) <= 64 and bool(key(name)) and vec is not None and len(vec) == dim
        length = np.linalg.norm(vec) if ok else 0.0
        if not ok or not np.isfinite(length) or length < 1e-6:
            out.append((seq, "bad_image", None, None, []))
            continue
        vec = np.asarray(vec, dtype=np.float64) / length
        species = next((s for s, _ in rows if key(s) == key(name)), None)
        if species is None:
            if not allow:
                close = difflib.get_close_matches(canonical(name), start, n=3, cutoff=0.6)
                out.append((seq, "unknown", None, None, close))
                continue
            species = canonical(name)
        elif max((float(v @ vec) for s, v in rows if s == species), default=-1.0) >= dup_sim:
            out.append((seq, "duplicate", species, None, []))
            continue
        rows.append((species, vec))
        out.append((seq, "learned", species, sum(s == species for s, _ in rows), []))
    return out


def shuffled_rows(plan):
    """Rows that the exchanges of an executed plan wrote."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return shuffled_rows(plan.executedPlan())
    if name in ("ShuffleQueryStageExec", "BroadcastQueryStageExec", "ResultQueryStageExec"):
        return shuffled_rows(plan.plan())
    own = plan.metrics().get("shuffleRecordsWritten").get().value() if name == "ShuffleExchangeExec" else 0
    return own + sum(shuffled_rows(plan.children().apply(i)) for i in range(plan.children().size()))
