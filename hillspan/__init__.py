"""hillspan: analytics of networks, flows and energy rankings on Spark."""
