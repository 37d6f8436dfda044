import numpy as np

from spanloom.llm.mixing import fit


def test_long_documents_are_weighed_too():
    """Where all that is left unused is longer than the words that are left."""
    for lengths, counts, budget, most in (
        ([1000, 1_200_000], [100, 1], 1_000_000, 200_000),
        ([1000, 950_000], [100, 1], 1_000_000, 0),
        ([1000, 2_500_000], [100, 1], 1_000_000, 900_000),
        ([1000, 890_000, 3_000_000], [100, 1, 1], 1_000_000, 10_000),
        ([300, 700_000], [1, 3], 1_000_000, 299_700),
        ([300_000, 400_000], [1, 1], 699_980, 20),
        ([400_000, 500_000], [2, 1], 800_000, 0),
        ([390_000, 401_000, 500_000, 777_777], [2, 1, 2, 1], 791_000, 0),
        ([1_000_000], [3], 1_900_000, 100_000),
    ):
        lengths, counts = np.array(lengths), np.array(counts)
        x = fit(lengths, counts, budget)
        assert (x >= 0).all() and (x <= counts).all() and abs(int((x * lengths).sum()) - budget) <= most


def test_small_and_large_budgets_are_fitted_alike():
    """The same documents with every length times 1,000: as near, in proportion, as by trying every choice."""
    rng = np.random.default_rng(8)
    for _ in range(40):
        lengths = np.unique(rng.integers(200, 900, 5))
        counts = rng.integers(1, 3, len(lengths))
        budget = int(rng.integers(300, (lengths * counts).sum()))
        choices = np.stack(np.meshgrid(*[np.arange(c + 1) for c in counts], indexing="ij"), -1).reshape(-1, len(counts))
        nearest = int(np.abs(choices @ lengths - budget).min())
        for k in (1, 1000):
            x = fit(lengths * k, counts, budget * k)
            assert (x >= 0).all() and (x <= counts).all()
            assert abs(int((x * lengths).sum()) - budget) <= nearest + 0.01 * budget, (lengths, counts, budget, k)


def test_long_documents_come_as_near_as_any_choice():
    """Random sources of one to four long lengths: within a hundredth of the budget of the best choice of all."""
    rng = np.random.default_rng(11)
    for _ in range(300):
        lengths = np.unique(rng.integers(60_000, 1_500_000, rng.integers(1, 5)))
        counts = rng.integers(1, 6, len(lengths))
        budget = int(rng.integers(100_000, (lengths * counts).sum()))
        choices = np.stack(np.meshgrid(*[np.arange(c + 1) for c in counts], indexing="ij"), -1).reshape(-1, len(counts))
        nearest = int(np.abs(choices @ lengths - budget).min())
        x = fit(lengths, counts, budget)
        assert (x >= 0).all() and (x <= counts).all()
        assert abs(int((x * lengths).sum()) - budget) <= nearest + 0.01 * budget, (lengths, counts, budget)
    for lengths, counts, budget, off in (([525_540, 1_396_653], [3, 2], 3_287_513, 31_333), ([327_213, 394_477], [3, 3], 782_140, 6_814)):
        x = fit(np.array(lengths), np.array(counts), budget)
        assert abs(int((x * np.array(lengths)).sum()) - budget) == off
