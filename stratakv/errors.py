"""Errors of the library. I/O errors stay Spark's own."""


class KvError(Exception):
    """Any error of this library."""


class MergeError(KvError):
    """A merge function failed or breaks its contract."""


class InvalidCompressionType(KvError, ValueError):
    """No codec has this name or number."""


class InvalidFormatVersion(KvError, ValueError):
    """The data are not of a known format version."""


class OrderError(KvError, ValueError):
    """Keys do not strictly ascend where they must."""
