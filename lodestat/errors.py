"""Typed errors raised by operators instead of generic failures."""


class LodestatError(ValueError):
    """Base class."""


class UnknownColumn(LodestatError):
    pass


class NotNumeric(LodestatError):
    pass


class UnknownOperation(LodestatError):
    pass


class EmptySource(LodestatError):
    pass


class TooManyCategories(LodestatError):
    pass


class NothingToUndo(LodestatError):
    pass


class NothingToRedo(LodestatError):
    pass


class NoModelTrained(LodestatError):
    pass


class NoCheckpointFolder(LodestatError):
    pass
