"""Settings of the store, as values that are passed and never global state."""

from __future__ import annotations

from dataclasses import dataclass, field

# Defaults that results depend on.
CHUNK_SIZE = 262_144
VNODES = 100
PRESIGN_TTL_SECONDS = 300
DEV_SECRET = "dev-secret-change-in-production"
REPLICA_TIMEOUT_MS = 3_000
COORDINATOR_BODY_LIMIT = 128 * 1024 * 1024
NODE_BODY_LIMIT = 64 * 1024 * 1024
HTTP_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5)
REPLICA_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)


@dataclass(frozen=True)
class Limiter:
    """Token bucket of one client: it starts full and refills continuously."""

    capacity: float = 500.0
    refill_per_second: float = 200.0
    cost: float = 1.0


@dataclass(frozen=True)
class StoreConfig:
    """Replicas of a chunk, acknowledgements a write needs, and ring points of a node."""

    replicas: int = 3
    write_quorum: int = 2
    vnodes: int = VNODES
    chunk_size: int = CHUNK_SIZE
    timeout_ms: int = REPLICA_TIMEOUT_MS
    limiter: Limiter = field(default_factory=lambda: Limiter(500.0, 300.0))

    def clamped(self, nodes: int) -> tuple[int, int]:
        """(replicas, quorum) for a topology of so many nodes; none of either for an empty one."""
        return min(self.replicas, nodes), min(self.write_quorum, nodes)
