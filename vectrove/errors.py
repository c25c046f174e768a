"""Errors of the library; each also is the built-in error that callers expect."""


class NotFound(KeyError):
    def __str__(self) -> str:
        return str(self.args[0]) if self.args else ""


class AlreadyExists(ValueError):
    pass


class DimensionMismatch(ValueError):
    def __init__(self, expected: int, actual: int):
        super().__init__(f"dimension mismatch: expected {expected}, got {actual}")


class InvalidConfig(RuntimeError):
    pass
