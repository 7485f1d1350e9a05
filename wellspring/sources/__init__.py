"""Readers (``readers``) and keyed writers (``writers``)."""
