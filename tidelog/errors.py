"""Errors of the engine; ``code`` is the number that a client sees."""

from __future__ import annotations


class LogError(Exception):
    code = 500


class FrameError(LogError):
    code = 1


class DecodeError(LogError):
    code = 2


class StorageError(LogError):
    code = 4


class CommitError(LogError):
    code = 5


class UnknownPartition(LogError):
    code = 10


class DuplicateTopic(LogError):
    code = 11


class BadPartitionCount(LogError):
    code = 12


class UnknownTopic(LogError):
    code = 13


class UnknownDescribedPartition(LogError):
    code = 14


class CheckpointWentBack(LogError):
    code = 500
