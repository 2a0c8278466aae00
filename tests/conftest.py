import pytest

from linklore.session import local_session
from linklore.sources.recording import NEIGHBORS, STREAMS, Recording

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, **{"spark.driver.memory": "8g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Recording from plain rows: ``make(gateway=[(session, seq, at_us, ...)])``."""

    def build(layout=None, params=None, neighbors=None, **streams):
        base = "session_id string, seq bigint, at_us bigint, "
        frames = {
            name: spark.createDataFrame(rows, base + STREAMS[name][1])
            for name, rows in streams.items()
        }
        heard = None
        if neighbors is not None:
            heard = spark.createDataFrame(neighbors, "session_id string, " + NEIGHBORS)
        extra = {}
        if layout is not None:
            extra["layout"] = layout
        if params is not None:
            extra["params"] = params
        return Recording(spark, frames, heard, **extra)

    return build


S = 1_000_000


def gateway(session, seq, secs, ms, ok=True, target="gw"):
    return (session, seq, int(secs * S), target, int(ms * 1_000_000), float(ms), ok, "icmp")


def counters(session, seq, secs, rx, tx=0, interface="en0", errors=(0, 0)):
    return (session, seq, int(secs * S), interface, rx, tx, 0, 0, *errors, None, None, None)


def dns(session, seq, secs, ms, ok=True, error=None):
    return (session, seq, int(secs * S), "1.1.1.1", "example.com", int(ms * 1e6), float(ms), ok, error)


def wifi(session, seq, secs, rssi=-50, ssid="Home", bssid="aa", channel=11, band="TwoPointFourGhz"):
    return (session, seq, int(secs * S), "en0", ssid, bssid, rssi, -95, None, channel, band,
            None, "Wpa2", None, "Direct")


def health(session, seq, secs, sensor, state):
    return (session, seq, int(secs * S), sensor, state, "b", None)


def neighbor(session, scan_seq, pos, channel, ssid=None, bssid=None, rssi=None, band="TwoPointFourGhz"):
    return (session, scan_seq, pos, bssid, ssid, rssi, channel, band, None, None, None, "Direct")
