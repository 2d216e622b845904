"""How jobs are put together: session settings, materialization, check registry, refresh and preprocessing runs."""
