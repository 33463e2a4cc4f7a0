"""Transports on the Python standard library.

Each is a plain class whose instances can be pickled; sockets are opened inside
the task that uses them.
"""

from __future__ import annotations

import http.client
import select
import socket
import urllib.error
import urllib.request
from typing import Any
from urllib.parse import SplitResult, urljoin, urlsplit

# Answers that name another place, and those of them after which
# the request is made again as it was (after the others, a GET).
REDIRECTS = (301, 302, 303, 307, 308)
SAME_METHOD = (307, 308)
MAX_REDIRECTS = 10


class HttpTransport:
    """POST the payload; any response, good or bad, is returned as it is.

    A task keeps one connection per scheme, host and port as long as the other
    end does.  A kept connection is looked at before it is used: one that the other
    end has closed is replaced before anything is sent, so nothing is sent twice.
    Redirects are followed, without credentials to another host.  Through a proxy
    (``http_proxy`` and the like) each request has a connection of its own.
    """

    def __init__(self, timeout: float | None = None):
        self.timeout = timeout
        self._kept: dict[tuple[str, str], http.client.HTTPConnection] = {}

    def __getstate__(self) -> dict:
        return {"timeout": self.timeout, "_kept": {}}

    def __call__(self, request: dict[str, Any], payload: str) -> tuple[int, str]:
        url, headers = request["url"], dict(request["headers"])
        method, data = "POST", payload.encode("utf-8")
        for _ in range(MAX_REDIRECTS + 1):
            place = urlsplit(url)
            if place.scheme not in ("http", "https") or not place.hostname or _has_proxy(place):
                return self._alone(url, method, data, headers)
            status, location, body = self._send(place, method, data, headers)
            if status not in REDIRECTS or not location:
                return status, body
            url = urljoin(url, location)
            if urlsplit(url).netloc != place.netloc:
                headers.pop("Authorization", None)
            if status not in SAME_METHOD:
                method, data = "GET", None
                headers.pop("Content-Type", None)
        raise OSError(f"more than {MAX_REDIRECTS} redirects")

    def _send(
        self, place: SplitResult, method: str, data: bytes | None, headers: dict[str, str]
    ) -> tuple[int, str | None, str]:
        key = (place.scheme, place.netloc)
        connection = self._connection(key, place)
        target = place.path or "/"
        if place.query:
            target = f"{target}?{place.query}"
        try:
            connection.request(method, target, body=data, headers=headers)
            response = connection.getresponse()
            body = response.read().decode("utf-8", "replace")
        except BaseException:
            # Half an answer may be left in it.
            self._drop(key)
            raise
        if response.will_close:
            self._drop(key)
        return response.status, response.getheader("Location"), body

    def _connection(self, key: tuple[str, str], place: SplitResult) -> http.client.HTTPConnection:
        kept = self._kept.get(key)
        if kept is not None and not _is_usable(kept):
            self._drop(key)
            kept = None
        if kept is None:
            kind = (
                http.client.HTTPSConnection
                if place.scheme == "https"
                else http.client.HTTPConnection
            )
            extra = {} if self.timeout is None else {"timeout": self.timeout}
            kept = self._kept[key] = kind(place.hostname, place.port, **extra)
        return kept

    def _alone(
        self, url: str, method: str, data: bytes | None, headers: dict[str, str]
    ) -> tuple[int, str]:
        post = urllib.request.Request(url, data=data, headers=headers, method=method)
        extra = {} if self.timeout is None else {"timeout": self.timeout}
        try:
            with urllib.request.urlopen(post, **extra) as response:
                return response.status, response.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as refused:
            return refused.code, refused.read().decode("utf-8", "replace")

    def _drop(self, key: tuple[str, str]) -> None:
        connection = self._kept.pop(key, None)
        if connection is not None:
            connection.close()

    def close(self) -> None:
        for key in list(self._kept):
            self._drop(key)


def _is_usable(connection: http.client.HTTPConnection) -> bool:
    """Nothing has come on an idle connection: neither its end nor stray bytes."""
    if connection.sock is None:
        return False
    poll = select.poll()
    poll.register(connection.sock, select.POLLIN)
    return not poll.poll(0)


def _has_proxy(place: SplitResult) -> bool:
    proxies = urllib.request.getproxies()
    return place.scheme in proxies and not urllib.request.proxy_bypass(place.hostname)


class SyslogTransport:
    """One datagram per UDP payload, one connection per TCP payload.

    A task looks a UDP target up once and keeps one socket for it.
    """

    def __init__(self):
        self._targets: dict[str, tuple] = {}

    def __getstate__(self) -> dict:
        return {"_targets": {}}

    def __call__(self, request: dict[str, Any], payload: str) -> tuple[int, str]:
        target = urlsplit(request["url"])
        data = payload.encode("utf-8")
        if target.scheme == "tcp":
            with socket.create_connection((target.hostname, target.port)) as stream:
                stream.sendall(data)
        else:
            datagram, address = self._target(request["url"], target.hostname, target.port)
            datagram.sendto(data, address)
        return 200, ""

    def _target(self, url: str, host: str, port: int) -> tuple:
        if url not in self._targets:
            found = socket.getaddrinfo(host, port, type=socket.SOCK_DGRAM)[0]
            self._targets[url] = (socket.socket(found[0], found[1]), found[4])
        return self._targets[url]

    def close(self) -> None:
        for datagram, _ in self._targets.values():
            datagram.close()
        self._targets = {}


class DefaultTransport:
    """Choose the transport by destination type."""

    def __init__(self, http: Any = None, syslog: Any = None):
        self.http = http or HttpTransport()
        self.syslog = syslog or SyslogTransport()

    def __call__(self, request: dict[str, Any], payload: str) -> tuple[int, str]:
        chosen = self.syslog if request["type"] == "syslog" else self.http
        return chosen(request, payload)

    def close(self) -> None:
        for transport in (self.http, self.syslog):
            getattr(transport, "close", lambda: None)()
