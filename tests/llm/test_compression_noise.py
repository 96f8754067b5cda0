from __future__ import annotations

import random
import string

import pytest

from quillon.llm.compression import BANDS, judge


@pytest.mark.parametrize("least", [b[0] for b in BANDS])
def test_noise_is_rejected_in_every_band(least):
    rng = random.Random(least)
    after = min([b[0] for b in BANDS if b[0] > least], default=2 * least)
    kinds = [string.ascii_letters + string.digits + "+/"] + [string.ascii_lowercase + string.digits] * (least >= 256)
    for n in (least, (least + after) // 2, after - 1):
        for alphabet in kinds:
            for _ in range(10 if n < 10_000 else 2):
                assert judge("".join(rng.choices(alphabet, k=n)).encode())[-2] == "incompressible", (n, len(alphabet))
