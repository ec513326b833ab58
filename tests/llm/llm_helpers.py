def auc(scored):
    """Share of (positive, negative) pairs in the right order; ties count half."""
    pos, neg = [s for s, y in scored if y], [s for s, y in scored if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
