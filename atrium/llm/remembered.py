"""A memory of values by string for whole batches: what a batch lacks is made at once."""

from __future__ import annotations

#: Longer keys are not remembered beyond their batch and the next ones of its generation.
LONGEST = 48


class Remembered(dict):
    """key -> value in two generations of ``most`` keys; ``pending`` says which of the asked keys are in neither."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.older = most, {}

    def pending(self, keys: set[str]) -> list[str]:
        if len(self) > self.most:
            self.older = {k: v for k, v in self.items() if len(k) <= LONGEST}
            self.clear()
        asked = keys.difference(self)
        older = self.older
        both = asked.intersection(older)
        self.update((k, older[k]) for k in both)
        return list(asked - both)
