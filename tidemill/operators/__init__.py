"""DataFrame operators on bars."""
