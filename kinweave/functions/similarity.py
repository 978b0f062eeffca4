"""Pair features. Set features are Catalyst expressions; Jaro-Winkler and common subsequences, which Spark lacks, are one Arrow kernel over blocks of pairs, with a short circuit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave import values as V
from kinweave.functions import match as M

#: Strings up to this length go through the kernels by whole blocks of pairs, longer ones pair by pair.
WIDTH, BLOCK = 128, 2048


def jaro_winkler(a: str, b: str) -> float:
    """Of one pair, in time linear in the strings' lengths: for each character the places in ``b`` are used from left to right, so one pointer each is enough."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    window = max(0, max(len(a), len(b)) // 2 - 1)
    places: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        places.setdefault(c, []).append(j)
    next_of, used, left = dict.fromkeys(places, 0), [], []
    for i, c in enumerate(a):
        own = places.get(c)
        if own is None:
            continue
        k = next_of[c]
        while k < len(own) and own[k] < i - window:
            k += 1
        if k < len(own) and own[k] <= i + window:
            used.append(own[k])
            left.append(c)
            k += 1
        next_of[c] = k
    m = len(left)
    if not m:
        return 0.0
    swaps = sum(x != b[j] for x, j in zip(left, sorted(used), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    same = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * same * (1 - jaro)


def subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _codes(texts: list[str], sizes: np.ndarray) -> np.ndarray:
    """Code points, a row per text, padded with zeros; in 16 bits if they fit."""
    width = max(1, int(sizes.max(initial=1)))
    codes = np.array(texts, f"<U{width}").view(np.uint32).reshape(len(texts), width)
    return codes.astype(np.uint16) if codes.max(initial=0) < 1 << 16 else codes


#: The lowest k bits.
_ONES = np.array([(1 << k) - 1 for k in range(65)], np.uint64)


def _bits(same: np.ndarray) -> np.ndarray:
    """Rows of truth values, 64 to a word, as words by rows."""
    return np.ascontiguousarray(np.packbits(same.reshape(-1), bitorder="little").view("<u8").reshape(len(same), -1).T)


def _masks(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray):
    """For each place of ``a`` and each pair the places of ``b`` with the same character, as the bits of as many words as ``b`` needs. They are found once for each character, unless there are more characters than places."""
    words, rows = -(-b.shape[1] // 64), len(b)
    real, inside = np.arange(b.shape[1]) < n[:, None], np.arange(a.shape[1]) < m[:, None]
    number = np.zeros(int(max(a.max(initial=0), b.max(initial=0))) + 1, np.uint8)
    number[a.reshape(-1)] = 1
    characters = np.flatnonzero(number)
    many = len(characters) > a.shape[1]
    # Places of no account are 0; so are characters that ``a`` has not, if numbers stand for them.
    padded = np.zeros((rows, 64 * words), np.uint32 if many else np.uint8)
    if many:
        padded[:, : b.shape[1]] = np.where(real, b.astype(np.uint32) + 1, 0)
        for i in range(a.shape[1]):
            yield i, _bits((padded == a[:, i, None].astype(np.uint32) + 1) & inside[:, i, None])
        return
    number[characters] = np.arange(1, len(characters) + 1)
    padded[:, : b.shape[1]] = number[b] * real
    # The first row is of no character at all.
    table = np.zeros((len(characters) + 1, words, rows), np.uint64)
    for k in range(1, len(table)):
        table[k] = _bits(padded == k)
    flat, own = table.reshape(-1), np.arange(rows)
    at = np.ascontiguousarray((number[a] * inside).T)
    for i in range(a.shape[1]):
        of = at[i] * np.intp(words * rows) + own
        yield i, [flat.take(of + w * rows if w else of) for w in range(words)]


def _places(words: list[np.ndarray], width: int) -> np.ndarray:
    return np.unpackbits(np.stack(words, 1).astype("<u8").view(np.uint8), axis=1, count=width, bitorder="little")


def _counted(words: list[np.ndarray]) -> np.ndarray:
    return sum(np.bitwise_count(w).astype(np.int64) for w in words)


def _both_block(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray, jaro_too: bool = True, common_too: bool = True) -> np.ndarray:
    """Jaro-Winkler and the length of the longest common subsequence, a row per pair, from the same masks; one of them alone where the other is off."""
    window, one, none = np.maximum(0, np.maximum(m, n) // 2 - 1), np.uint64(1), np.zeros(len(a), np.uint64)
    # The places of b that exist, those that no character has taken yet, and those within the window.
    real, band = ([_ONES[np.clip(size - 64 * w, 0, 64)] for w in range(-(-b.shape[1] // 64))] for size in (n, window + 1))
    row, free, taken = [~none for _ in real], list(real), [none.copy() for _ in range(-(-a.shape[1] // 64))]
    for i, mask in _masks(a, m, b, n):
        if common_too:
            carry = none
            for w, here in enumerate(mask):
                # Bits beyond ``n`` never match, so they stay set and are taken off at the end.
                hit = row[w] & here
                total = row[w] + hit
                if len(mask) > 1:
                    over, total = total < hit, total + carry
                    carry = (over | (total < carry)).astype(np.uint64)
                row[w] = total | (row[w] - hit)
        if jaro_too:
            # The first free place within the window.
            before = None
            for w, here in enumerate(mask):
                fits = here & free[w] & band[w]
                first = fits & -fits
                if before is not None:
                    first[before] = 0
                free[w] = free[w] ^ first
                found = first != 0
                before = found if before is None else before | found
            taken[i // 64] |= before.astype(np.uint64) << np.uint64(i % 64)
            for w in reversed(range(len(band))):
                band[w] = (band[w] << one) | ((band[w - 1] >> np.uint64(63)) if w else (i < window).astype(np.uint64))
    common = n - _counted([x & y for x, y in zip(row, real, strict=True)])
    if not jaro_too:
        return common
    # Both sides' matched characters in row order stand in step.
    r, k = np.nonzero(_places(taken, a.shape[1]))
    s, l = np.nonzero(_places([x & ~y for x, y in zip(real, free, strict=True)], b.shape[1]))
    matched = _counted(taken)
    swaps = np.bincount(r, a[r, k] != b[s, l], len(a)) // 2
    found = np.maximum(matched, 1)
    jaro = np.where(matched > 0, (matched / np.maximum(m, 1) + matched / np.maximum(n, 1) + (matched - swaps) / found) / 3, 0.0)
    w = min(4, a.shape[1], b.shape[1])
    same = (a[:, :w] == b[:, :w]) & (np.arange(w) < np.minimum(m, n)[:, None])
    jaro = np.where(jaro > 0.7, jaro + 0.1 * np.cumprod(same, 1).sum(1) * (1 - jaro), jaro)
    return np.stack([jaro, common], 1) if common_too else jaro


def _pairwise(a: list[str], b: list[str], block, single, kind, shape: tuple = ()) -> np.ndarray:
    """``single`` of every pair, by blocks of pairs of like length where both strings are short enough."""
    m, n = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    out = np.zeros((len(a), *shape), kind)
    longest = np.maximum(m, n)
    for k in np.flatnonzero(longest > WIDTH):
        out[k] = single(a[k], b[k])
    short = np.flatnonzero((longest <= WIDTH) & (m > 0) & (n > 0))
    short = short[np.argsort(longest[short], kind="stable")]
    for at in range(0, len(short), BLOCK):
        own = short[at : at + BLOCK]
        x, y = [a[k] for k in own], [b[k] for k in own]
        out[own] = block(_codes(x, m[own]), m[own], _codes(y, n[own]), n[own])
    return out


def both(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro-Winkler and the longest common subsequence of every pair, two columns."""
    return _pairwise(a, b, _both_block, lambda x, y: (jaro_winkler(x, y), subsequence(x, y)), np.float64, (2,))


def jaro_winklers(a: list[str], b: list[str]) -> np.ndarray:
    return _pairwise(a, b, lambda *x: _both_block(*x, common_too=False), jaro_winkler, np.float64)


def subsequences(a: list[str], b: list[str]) -> np.ndarray:
    return _pairwise(a, b, lambda *x: _both_block(*x, jaro_too=False), subsequence, np.int64)


def distinct(a: pd.Series, b: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of strings: a place of each different one, and for every place the number of its pair."""
    (x, _), (y, others) = pd.factorize(a), pd.factorize(b)
    _, first, of = np.unique(x.astype(np.int64) * len(others) + y, return_index=True, return_inverse=True)
    return first, of


_KERNELS = ["name_jw", "addr_jw", "ascii_jw", "name_lcs", "sort_lcs", "set_lcs", "addr_lcs"]


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in _KERNELS]))
def kernels(n1: pd.Series, n2: pd.Series, x1: pd.Series, x2: pd.Series, g1: pd.Series, g2: pd.Series, s1: pd.Series, s2: pd.Series, o1: pd.Series, o2: pd.Series, t1: pd.Series, t2: pd.Series) -> pd.DataFrame:
    """What Spark lacks, for a batch of pairs: Jaro-Winkler of names, addresses and ASCII names; common subsequences of names, sorted names, the words that only
    one name has, and sorted addresses. Pairs that are far apart in both get the first two only. All that is of names follows from ``n1`` and ``n2`` and is worked out once for each two of them."""
    out = pd.DataFrame(0.0, index=range(len(n1)), columns=_KERNELS)
    first, of = distinct(n1, n2)
    of_names = lambda f, a, b, at=slice(None): f(a.iloc[first[at]].tolist(), b.iloc[first[at]].tolist())
    names = of_names(both, n1, n2)
    out["name_jw"], out["addr_jw"] = names[of, 0], jaro_winklers(x1.tolist(), x2.tolist())
    close = ((out["name_jw"] >= V.SHORT_CIRCUIT) | (out["addr_jw"] >= V.SHORT_CIRCUIT)).to_numpy()
    out["name_lcs"] = np.where(close, names[of, 1], 0)
    near = np.bincount(of[close], minlength=len(first)) > 0
    # A name that is ASCII already has its figure.
    plain = ((n1 == g1) & (n2 == g2)).to_numpy()[first]
    for name, f, a, b, own in (("ascii_jw", jaro_winklers, g1, g2, near & ~plain), ("sort_lcs", subsequences, s1, s2, near), ("set_lcs", subsequences, o1, o2, near)):
        values = names[:, 0].copy() if name == "ascii_jw" else np.zeros(len(first))
        values[own] = of_names(f, a, b, own)
        out[name] = np.where(close, values[of], 0)
    own = np.flatnonzero(close)
    values = np.zeros(len(out))
    values[own] = subsequences(t1.iloc[own].tolist(), t2.iloc[own].tolist())
    out["addr_lcs"] = values
    return out


@F.pandas_udf(T.DoubleType())
def jaro_winkler_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(jaro_winklers(a.tolist(), b.tolist()))


def indel_ratio(lcs: Column, a: Column, b: Column) -> Column:
    both = F.length(a) + F.length(b)
    return F.when(both > 0, 2 * lcs / both).otherwise(F.lit(1.0))


def token_set(lcs: Column, empty: Column, length: Column, only_x: Column, only_y: Column) -> Column:
    """Of two sets of words: whether one is empty, the length of the shared words joined, and what only one side has as sorted, joined words and their common subsequence."""

    def of(common: Column) -> Column:
        gap = (common > 0).cast("int")
        left, right = common + gap + F.length(only_x), common + gap + F.length(only_y)
        best = 1 - (F.length(only_x) + F.length(only_y) - 2 * lcs) / (left + right)
        more = F.greatest(best, 1 - (gap + F.length(only_x)) / (common + left), 1 - (gap + F.length(only_y)) / (common + right))
        one = (common > 0) & ((only_x == "") | (only_y == ""))
        return F.when(empty, F.lit(0.0)).when(one, F.lit(1.0)).when(common > 0, more).otherwise(best)

    return of(length)


def _sorted(words: Column) -> Column:
    return F.array_join(F.array_sort(words), " ")


def jaccard(common: Column, m: Column, n: Column) -> Column:
    """Of two sets by their sizes; both empty 1, one empty 0."""
    return F.when((m == 0) & (n == 0), F.lit(1.0)).when((m == 0) | (n == 0), F.lit(0.0)).otherwise(common / (m + n - common))


def containment(common: Column, m: Column, n: Column) -> Column:
    return F.when((m == 0) & (n == 0), F.lit(1.0)).when((m == 0) | (n == 0), F.lit(0.0)).otherwise(common / F.least(m, n))


def length_ratio(a: Column, b: Column) -> Column:
    m, n = F.length(a), F.length(b)
    return F.when((m == 0) & (n == 0), F.lit(1.0)).when((m == 0) | (n == 0), F.lit(0.0)).otherwise(F.least(m, n) / F.greatest(m, n))


def soundex_codes(normalised: Column) -> Column:
    only = F.transform(F.split(normalised, " "), lambda t: F.regexp_replace(t, "[^a-z]", ""))
    return F.array_distinct(F.transform(F.filter(only, lambda t: F.length(t) >= 2), lambda t: F.soundex(t)))


def postal_match(a: Column, b: Column) -> Column:
    return F.when((a == "") & (b == ""), F.lit(0.5)).when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))


def normalised(entities: DataFrame) -> DataFrame:
    """What pair features need of each entity (entity_id, name, addr, country), worked out once per entity, before pairs are made."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    df = entities.select("entity_id", text("name").alias("name"), text("addr").alias("addr"), text("country").alias("country"))
    df = df.withColumns({"n_name": M.match_name(F.col("name")), "n_addr": M.match_address(F.col("addr"))})
    df = df.withColumns({"g_name": M.match_name_ascii(F.col("n_name")), "x_addr": M.match_address(M.expand_address(F.col("addr"), F.col("country")))})
    return df.select(
        "entity_id", "n_name", "g_name", "n_addr", "x_addr", F.lower(F.trim("country")).alias("land"), F.array_distinct(M.tokens(F.col("n_name"))).alias("name_tokens"), F.array_distinct(M.tokens(F.col("x_addr"))).alias("addr_tokens"),
        _sorted(M.tokens(F.col("n_name"))).alias("sorted_name"), _sorted(M.tokens(F.col("x_addr"))).alias("sorted_addr"),
        F.array_distinct(M.numbers(F.col("addr"))).alias("numbers"), M.postal_code(F.col("addr"), F.col("country")).alias("postal"), soundex_codes(F.col("g_name")).alias("sounds"),
    )


_EMPTY = {"string": lambda: F.lit(""), "array<string>": lambda: F.array().cast("array<string>")}


def pair_features(pairs: DataFrame, s1: DataFrame, others: DataFrame) -> DataFrame:
    """``pairs`` (s1_id, cand_id and any others, which follow) with the 23 features as floats. ``s1``, ``others``: ``normalised`` entities; missing ones count as empty."""
    side = lambda df, k: df.select([F.col(c).alias(f"{c}_{k}") for c in df.columns])
    df = pairs.join(side(s1, 1), F.col("s1_id") == F.col("entity_id_1"), "left").join(side(others, 2), F.col("cand_id") == F.col("entity_id_2"), "left").drop("entity_id_1", "entity_id_2")
    df = df.withColumns({c: F.coalesce(F.col(c), _EMPTY[t]()) for c, t in df.dtypes if c[-2:] in ("_1", "_2") and t in _EMPTY})
    two = lambda f, c: f(F.col(f"{c}_1"), F.col(f"{c}_2"))
    df = df.withColumns({f"only_{a}": _sorted(F.array_except(f"name_tokens_{a}", f"name_tokens_{b}")) for a, b in ((1, 2), (2, 1))})
    # Sets are met before the kernels, once each, and only their sizes go on.
    sets = ("name_tokens", "addr_tokens", "numbers", "sounds")
    df = df.withColumn("shared", F.array_intersect("name_tokens_1", "name_tokens_2"))
    df = df.withColumns({f"{c}_n{k}": F.size(f"{c}_{k}") for c in sets for k in (1, 2)} | {f"{c}_n": F.size("shared" if c == "name_tokens" else F.array_intersect(f"{c}_1", f"{c}_2")) for c in sets} | {"shared_length": F.length(F.array_join("shared", " "))})
    df = df.drop("shared", *[f"{c}_{k}" for c in sets for k in (1, 2)])
    df = df.withColumn("t", kernels(*[f"{c}_{k}" for c in ("n_name", "x_addr", "g_name", "sorted_name", "only", "sorted_addr") for k in (1, 2)]))
    of_sets = lambda f, c: f(F.col(f"{c}_n"), F.col(f"{c}_n1"), F.col(f"{c}_n2"))
    ratio = lambda lcs, c: indel_ratio(F.col(f"t.{lcs}"), F.col(f"{c}_1"), F.col(f"{c}_2"))
    name_sort, addr_sort = ratio("sort_lcs", "sorted_name"), ratio("addr_lcs", "sorted_addr")
    yes = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    jw, aw = F.col("t.name_jw"), F.col("t.addr_jw")
    short = (jw < V.SHORT_CIRCUIT) & (aw < V.SHORT_CIRCUIT)
    far = {
        "name_jaro_winkler": jw, "addr_jaro_winkler": aw, "addr_postal_match": F.lit(0.5), "addr_any_empty": yes((F.col("n_addr_1") == "") | (F.col("n_addr_2") == "")),
        "country_match": yes((F.col("land_1") == F.col("land_2")) & (F.col("land_1") != "")), "source_type": yes(F.substring("cand_id", 1, 2) != "S2"),
        "geo_mean_name_addr": F.sqrt(jw * aw), "min_name_addr_sim": F.least(jw, aw), "max_name_addr_sim": F.greatest(jw, aw),
    }
    near = far | {
        "name_levenshtein": ratio("name_lcs", "n_name"), "name_jaccard": of_sets(jaccard, "name_tokens"), "name_token_sort": name_sort, "name_token_set": token_set(F.col("t.set_lcs"), (F.col("name_tokens_n1") == 0) | (F.col("name_tokens_n2") == 0), F.col("shared_length"), F.col("only_1"), F.col("only_2")),
        "name_containment": of_sets(containment, "name_tokens"), "name_exact": yes((F.col("n_name_1") == F.col("n_name_2")) & (F.col("n_name_1") != "")), "name_length_ratio": two(length_ratio, "n_name"),
        "name_aggressive_jw": F.col("t.ascii_jw"), "name_soundex_overlap": of_sets(jaccard, "sounds"), "addr_jaccard": of_sets(jaccard, "addr_tokens"), "addr_token_sort": addr_sort,
        "addr_number_overlap": of_sets(jaccard, "numbers"), "addr_postal_match": two(postal_match, "postal"), "addr_length_ratio": two(length_ratio, "x_addr"), "addr_containment": of_sets(containment, "addr_tokens"),
        "min_name_addr_sim": F.least(name_sort, addr_sort), "max_name_addr_sim": F.greatest(name_sort, addr_sort),
    }
    return df.select("s1_id", "cand_id", *[F.when(short, far.get(f, F.lit(0.0))).otherwise(near[f]).cast("float").alias(f) for f in V.FEATURES], *[c for c in pairs.columns if c not in ("s1_id", "cand_id")])
