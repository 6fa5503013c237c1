"""A model whose sessions note in a folder when they are opened and closed (sent to the workers by its test)."""

import os
import uuid

import numpy as np


class Sessions:
    width, classes = 2, 2

    def __init__(self, folder, fail=False):
        self.folder, self.fail = folder, fail

    def _note(self, what):
        with open(os.path.join(self.folder, f"{what}-{uuid.uuid4().hex}"), "w"):
            pass

    def open(self):
        self._note("open")
        return self

    def predict(self, x):
        if self.fail and (x > 900).any():
            raise ValueError("session broke")
        return np.stack([x[:, 0], 1 - x[:, 0]], axis=1)

    def close(self):
        self._note("close")
