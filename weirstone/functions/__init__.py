"""Column functions that several operators share; all run inside generated code or as SQL expressions."""

from weirstone.functions.columns import broadcast_if_small, dot, epoch_ms, in_base_currency, plain_path, slug, strip

__all__ = ["broadcast_if_small", "dot", "epoch_ms", "in_base_currency", "plain_path", "slug", "strip"]
