"""Errors of scripts."""


class ScriptError(ValueError):
    """Something in a script is wrong; ``line`` and ``column`` say where, counted from 1."""

    def __init__(self, message: str, line: int = 0, column: int = 0):
        super().__init__(f"{message} (line {line}, column {column})" if line else message)
        self.line, self.column = line, column


class LexicalError(ScriptError):
    pass


class SyntaxErrors(ScriptError):
    """All syntax errors of a script; ``errors`` has each."""

    def __init__(self, errors: list[ScriptError]):
        super().__init__("; ".join(map(str, errors)), errors[0].line, errors[0].column)
        self.errors = errors


class SemanticError(ScriptError):
    pass
