"""Classifying failures: which are worth a retry, and which are a used-up quota."""

from __future__ import annotations

import logging
import re
import time
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
# Attempts and seconds between them.
ATTEMPTS, DELAY = 3, 5.0
# What is looked for in class names, status codes and messages.
CLASS_TERMS = ("Timeout", "ConnectError", "ConnectTimeout", "ReadTimeout", "WriteTimeout", "PoolTimeout", "NetworkError", "APIConnectionError", "APIConnection")
BUILT_IN = ("TimeoutError", "ConnectionError", "ConnectionResetError", "ConnectionRefusedError", "ConnectionAbortedError", "BrokenPipeError")
RETRY_STATUS = (503, 429, 502, 504, 500, 408)
DENY_TERMS = ("unauthorized", "forbidden", "not found", "bad request", "invalid argument", "permission denied", "validation error")
DENY_CODES = r"\b(400|401|403|404)\b"
RETRY_TERMS = ("service unavailable", "resource exhausted", "too many requests", "rate limit", "quota", "unavailable", "temporary", "transient", "overloaded", "deadline exceeded", "timeout", "timed out")
RETRY_CODES = r"\b(500|502|503|504|429|408)\b"


def _any(text: Column, terms) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(t) for t in terms))


def retryable(class_name: Column, status: Column, message: Column) -> Column:
    """By class first, then by status, and only without one by the message: denials precede."""
    said = F.lower(F.coalesce(message, F.lit("")))
    name = F.coalesce(class_name, F.lit(""))
    return (
        F.when(name.isin(*BUILT_IN) | _any(name, CLASS_TERMS), True)
        .when(status.isNotNull(), status.isin(*RETRY_STATUS))
        .when(_any(said, DENY_TERMS) | said.rlike(DENY_CODES), False)
        .otherwise(_any(said, RETRY_TERMS) | said.rlike(RETRY_CODES))
    )


def rate_limited(message: Column) -> Column:
    return message.contains("429") | message.contains("RESOURCE_EXHAUSTED") | F.lower(message).contains("quota")


def is_retryable(problem: BaseException) -> bool:
    """``retryable`` for an exception at hand, on executors too: names along its classes, status, message."""
    names = [c.__name__ for c in type(problem).__mro__]
    if any(n in BUILT_IN for n in names) or any(t in names[0] for t in CLASS_TERMS):
        return True
    status = getattr(problem, "status_code", None) or getattr(problem, "code", None) or getattr(getattr(problem, "response", None), "status_code", None)
    if isinstance(status, int):
        return status in RETRY_STATUS
    said = str(problem).lower()
    denied = any(t in said for t in DENY_TERMS) or re.search(DENY_CODES, said)
    return not denied and bool(any(t in said for t in RETRY_TERMS) or re.search(RETRY_CODES, said))


def retried(call: Callable, attempts: int = ATTEMPTS, delay: float = DELAY, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` made again where that may help; other problems, and the last one, are raised."""

    def run(*args, **kwargs):
        for left in range(attempts - 1, -1, -1):
            try:
                return call(*args, **kwargs)
            except Exception as problem:
                if not left or not is_retryable(problem):
                    raise
                log.warning("%s; %d attempts left", problem, left)
                sleep(delay)

    return run


def retried_stream(make: Callable[[], Iterator], attempts: int = ATTEMPTS, delay: float = DELAY, sleep: Callable[[float], None] = time.sleep) -> Iterator:
    """The items of ``make()``, begun again only as long as nothing has come out of it."""
    first = retried(lambda: (items := iter(make()), next(items, items)), attempts, delay, sleep)
    items, item = first()
    if item is not items:
        yield item
        yield from items
